"""Benchmark decontamination by the CGK embedding of edit distance into Hamming distance.

Symbols are folded words. An item of n words is found where a stretch of a document is within k = floor(edits * n) word
insertions, deletions and replacements. The stages, for every document over its whole text:

1. CGK random walks. From a place of a text a pointer walks over the words from there on; step j emits the word under the pointer, which moves
   on where bit j of a random function of the word says so. Equal stretches give equal walks, and walks that an edit has set apart drift
   together again, so few edits mean few differing steps: edit distance becomes Hamming distance.
2. Bit sampling. ``WALKS`` walks with functions of their own are sampled at ``SYMBOLS`` steps each, the first step among them, within each of ``DEPTHS``
   steps. Windows of an item start at each of its words, those of a document at each word that the items hold; a sample of an item counts
   where it lies inside the item and visits at least three of its words (all, if it has fewer). A place of a document is a candidate for an item
   where any sample equals one of the item's. Edits leave an unbroken run of at least (n - k) / (k + 1) words, over which
   every sample that stays inside agrees, and beyond it samples agree where the walks met again: the tests hold the recall to 0.95 at exactly k edits of each kind.
   An item without any sample inside it is sought by its first word.
3. Exact verification: a candidate whose surroundings hold fewer than n - k of the item's words is passed over without loss; for the
   rest, the edit distance between the item and the best stretch is computed.

The benchmark is taken in blocks of at most ``block_words`` words. A block's texts are broadcast and indexed by each worker; a block costs one
scan. Of several blocks, each is scanned and its rows written before the next is read, so that neither the driver nor a worker holds two.

Defined results: null and empty items and texts match nothing; an item of one or two words is found wherever these stand, like any other;
repeated items, item ids and documents each match on their own; rows with a null id are carried; other columns are ignored; an empty
table on either side gives no rows. An item too long for block_words is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, ready
from ._text import blocks, mix, words_of

EDITS, WALKS, DEPTHS, SYMBOLS = 0.15, 8, (4, 8, 12, 16), 4
_REACH, _SLICE = 1 << 16, 1 << 15


def _samples(seed: int = 5) -> list[tuple[int, tuple[int, ...], np.ndarray, np.uint64]]:
    """(walk, steps, a factor for each step, summand) of every sample; the last is the first word alone."""
    rng = np.random.default_rng(seed)
    out = []
    for walk in range(WALKS):
        for depth in DEPTHS:
            steps = (0, *sorted(rng.choice(np.arange(1, depth), SYMBOLS - 1, replace=False).tolist()))
            out.append((walk, steps, rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, dtype=np.uint64)))
    out.append((0, (0,), rng.integers(1, 2**63, 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, dtype=np.uint64)))
    return out


_SAMPLES = _samples()
_SEEDS = [np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64) for r in range(WALKS)]


def walk_keys(h: np.ndarray, at: np.ndarray, functions: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each sample: its keys over the windows from these places on, and the places it visits. h has max(DEPTHS) words to spare."""
    for walk in range(WALKS):
        mine = [x for x in _SAMPLES if x[0] == walk]
        used = {j for x in mine for j in x[1]}
        place, places, symbols = at, {0: at}, {0: h.take(at)}
        for j in range(max(DEPTHS) - 1):
            move = functions[walk].take(place)
            move >>= np.uint64(j)
            move &= np.uint64(1)
            place = place + move.view(np.int64)
            if j + 1 in used:
                places[j + 1], symbols[j + 1] = place, h.take(place)
        for _, steps, factors, summand in mine:
            key = symbols[0] * factors[0]
            key += summand
            for j, f in zip(steps[1:], factors[1:]):
                key += symbols[j] * f
            yield key, [places[j] for j in steps]


def spare(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """h with words to spare, and the random function of each walk over them."""
    h = np.concatenate([h, np.zeros(max(DEPTHS), np.uint64)])
    return h, [mix(h ^ seed) for seed in _SEEDS]


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the stretch of region that is nearest to item, by words."""
    m = len(region)
    prev, steps = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, w in enumerate(item):
        cur = prev + 1
        cur[1:] = np.minimum(cur[1:], prev[:-1] + (region != w))
        cur[0] = i + 1
        prev = np.minimum.accumulate(cur - steps) + steps
    return int(prev.min()), int(prev.argmin())


class Index:
    """The items of one block. Only their texts are shipped; the index is built where it is first used."""

    def __init__(self, items: list[tuple[int | None, bytes]], edits: float = EDITS):
        self.items, self.edits, self.keys = items, edits, None

    def __getstate__(self) -> tuple:
        return self.items, self.edits

    def __setstate__(self, state: tuple) -> None:
        self.items, self.edits, self.keys = *state, None

    def build(self) -> None:
        h, bounds = words_of([t for _, t in self.items])[:2]
        kept = [i for i in range(len(self.items)) if bounds[i + 1] > bounds[i]]
        self.ids = [self.items[i][0] for i in kept]
        self.first = bounds[kept] if kept else np.zeros(0, np.int64)
        self.n = np.array([bounds[i + 1] - bounds[i] for i in kept], np.int64)
        self.k = np.floor(self.edits * self.n + 1e-9).astype(np.int64)
        self.words = [h[a : a + n] for a, n in zip(self.first, self.n)]
        self.h, item = h, np.repeat(np.arange(len(kept)), self.n)
        at = np.arange(len(h))
        past = (self.first + self.n)[item]
        keys, where = [], []
        met = np.zeros(len(kept), bool)  # items that have samples, those without edits at their first word
        for s, (key, places) in enumerate(walk_keys(*self._padded(at))):
            visited = 1 + sum(((b > a).astype(np.int64) for a, b in zip(places, places[1:])), np.zeros(len(at), np.int64))
            good = (places[-1] < past) & (visited >= np.minimum(3, self.n[item]))
            if len(places) == 1:
                alone = key
                continue
            keys.append(key[good])
            where.append(np.flatnonzero(good))
            met[item[good & ((self.k[item] > 0) | (at == self.first[item]))]] = True
        lone = np.flatnonzero(~met[item] & ((self.k[item] > 0) | (at == self.first[item])))
        keys.append(alone[lone])
        where.append(lone)
        keys, where = np.concatenate(keys), np.concatenate(where)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = item[where[order]].astype(np.int32)
        self.offset = (where[order] - self.first[self.item]).astype(np.int32)
        bits = max(12, min(27, int(len(keys)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True
        self.starts = np.zeros(1 << 22, bool)
        self.starts[(h >> np.uint64(42)).astype(np.int64)] = True

    def _padded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        h, functions = spare(self.h)
        return h, at, functions

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word), sorted and once each, where a sample of a window equals one of an item."""
        at = np.flatnonzero(self.starts[(h >> np.uint64(42)).astype(np.int64)])
        found: list[np.ndarray] = []
        padded, functions = spare(h)
        for a in range(0, len(at), _SLICE):
            some = at[a : a + _SLICE]
            for key, places in walk_keys(padded, some, functions):
                hit = np.flatnonzero(self.map[(key >> self.shift).astype(np.int64)])
                if not len(hit):
                    continue
                key, place = key[hit], some[hit]
                lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                while (hi > lo).any():  # windows that many items share are expanded by turns, so that memory stays bounded
                    each = np.minimum(hi - lo, max(1, (1 << 20) // len(lo)))
                    row = np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    pos = np.repeat(place, each)
                    found.append(np.stack([np.searchsorted(bounds, pos, "right") - 1, self.item[row], pos - self.offset[row]]))
                    lo = lo + each
                if sum(x.shape[1] for x in found) > 1 << 21:
                    found = [_unique(found)]
        return tuple(_unique(found)) if found else (np.zeros(0, np.int64),) * 3

    def likely(self, doc: np.ndarray, item: np.ndarray, start: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which candidates' surroundings may hold n - k of the item's words, by two sets of 64 bits."""
        good = np.zeros(len(doc), bool)
        order = np.argsort(self.n[item], kind="stable")
        masks = [np.uint64(1) << ((x >> np.uint64(b)) & np.uint64(63)) for b in (8, 20) for x in (h,)]
        own = [np.uint64(1) << ((self.h >> np.uint64(b)) & np.uint64(63)) for b in (8, 20)]
        a = 0
        while a < len(order):
            longest = int(self.n[item[order[min(len(order), a + 4096) - 1]]])
            x = order[a : a + max(1, min(4096, (1 << 21) // (longest + 1)))]
            a += len(x)
            d, i, s = doc[x], item[x], start[x]
            n, k = self.n[i], self.k[i]
            at = (s - k)[:, None] + np.arange(int((n + 2 * k).max()))
            there = (at >= bounds[d][:, None]) & (at < np.minimum(s + n + k, bounds[d + 1])[:, None])
            at = np.clip(at, 0, len(h) - 1)
            word = self.first[i][:, None] + np.arange(int(n.max()))
            inside = word < (self.first[i] + n)[:, None]
            word = np.minimum(word, len(self.h) - 1)
            for mask, bit in zip(masks, own):
                held = np.bitwise_or.reduce(np.where(there, mask[at], np.uint64(0)), axis=1)
                inside &= (bit[word] & held[:, None]) != 0
            good[x] = inside.sum(1) >= n - k
        return good

    def find(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance) of the best occurrence of each item in each text."""
        if self.keys is None:
            self.build()
        if not len(h) or not len(self.keys):
            return []
        doc, item, start = self.candidates(h, bounds)
        good = self.likely(doc, item, start, h, bounds)
        doc, item, start = doc[good], item[good], start[good]
        out: dict[tuple[int, int], tuple] = {}
        a = 0
        while a < len(doc):  # candidates that lie at most k apart are verified together
            d, i, n, k = doc[a], item[a], self.n[item[a]], self.k[item[a]]
            b = a + 1
            while b < len(doc) and (doc[b], item[b]) == (d, i) and start[b] - start[b - 1] <= k and start[b] - start[a] <= _REACH:
                b += 1
            if (d, i) not in out or out[d, i][4]:
                first = max(start[a] - k, bounds[d])
                region = h[first : min(start[b - 1] + n + k, bounds[d + 1])]
                if np.isin(self.words[i], region).sum() >= n - k:
                    dist, end = edit_distance(self.words[i], region)
                    if dist <= k and ((d, i) not in out or dist < out[d, i][4]):
                        size = edit_distance(self.words[i][::-1], region[max(0, end - n - k) : end][::-1])[1] if dist else int(n)
                        out[d, i] = (int(d), int(i), int(first + end - size - bounds[d]), size, dist)
            a = b
        return list(out.values())


def _unique(found: list[np.ndarray]) -> np.ndarray:
    """The columns (text, item, first word), sorted and once each."""
    x = np.concatenate(found, axis=1)
    x = x[:, np.lexsort(x[::-1])]
    fresh = np.ones(x.shape[1], bool)
    fresh[1:] = (x[:, 1:] != x[:, :-1]).any(0)
    return x[:, fresh]


def _scan(rows: DataFrame, shared) -> DataFrame:
    """Rows of one block; shared: the broadcast Index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in blocks(texts):
                h, bounds = words_of(texts[a:b])[:2]
                got = ix.find(h, bounds)
                if got:
                    cols = [
                        ids.take(pa.array([a + x[0] for x in got])), pa.array([ix.ids[x[1]] for x in got], pa.int64()),
                        *(pa.array([x[j] for x in got], pa.int64()) for j in (2, 3, 4)),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "first_word", "n_words", "distance"])

    return rows.mapInArrow(run, "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, distance bigint")


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", edits: float = EDITS, block_words: int = 200_000,
) -> DataFrame:
    """A row for each document and item that occurs in it: doc_id, item_id, first_word and n_words of the best stretch, distance in words."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint"), F.col(item_text_col).cast("binary")).where(F.col(item_text_col).isNotNull())
    parts, block, held = [], [], 0
    for r in items.toLocalIterator():  # no more than a block is held at once
        size = len(bytes(r[1]).split())
        if block and held + size > block_words:
            shared = spark.sparkContext.broadcast(Index(block, edits))
            parts.append(materialise(_scan(rows, shared), "leaks"))
            shared.destroy()
            block, held = [], 0
        block.append((r[0], bytes(r[1])))
        held += size
    last = _scan(rows, spark.sparkContext.broadcast(Index(block, edits)))
    return reduce(DataFrame.union, [*parts, last])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose text holds an item of the benchmark, whatever their ids."""
    key = F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.select(key.alias("__text"), F.col(text_col).alias("__said"))
    bad = materialise(find(keyed, benchmark, "__text", "__said", **options).select(F.col("doc_id").alias("__bad")).distinct(), "leaks")
    return docs.join(bad, key == F.col("__bad"), "left_anti")
