"""SimHash near-duplicates by deletion-variant signatures: fingerprints that differ in at most ``BITS`` of 64 bits are linked.

A document's features are its k-word shingles, repeats included (words folded A-Z to a-z, joined by one space; with fewer words the whole sequence is the
one shingle). Bit b of the fingerprint is set where over half of the shingles' XXH64 (seed 42) have it; without words it is zero.

Equal fingerprints are one class. A fingerprint is cut into ``SEGMENTS`` = 3 segments only, so of two that differ in 4 bits or fewer one segment differs in
one bit at most. Each segment emits a key for each of its bits, the segment with that bit left out: 64 keys a fingerprint. Segments that are
equal or one bit apart share such a key, so an equality join (one shuffle by key) brings every linked pair together, where it is verified on the whole
fingerprints.

Pairs of a group are never emitted: within a key, a group of up to ``FEW`` is compared row by following row, and a larger one breadth-first against
what is not reached yet, so that a group of near copies gives a link a member, and no link between components is lost. A segment value that over
``MANY / 2`` fingerprints hold would make a group that is too large for a task. The keys around such values are known from counts by segment value,
made before the shuffle, and their members are linked another exact way, of the same work whatever the size of a group: two fingerprints are within 4 bits exactly
where some point is within 2 bits of both, so each member emits its 2,081 points and each point links its members to the least of them.
Components are merged by distributed union-find (``components``).

Defined results: a null or empty text, and one without words, has fingerprint zero, which links like any other; a row with a null id has component null and
links nothing; rows that repeat an id each get the component of their own text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, materialise, ready

BITS, SHINGLE, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 43), (43, 64))  # of bits: one differs in at most BITS // 3 = 1
FEW, MANY = 32, 32_768
_PIECE, _HASHES = 1 << 20, 1 << 16  # bytes and shingles that are held at once, whatever the length of a text
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WHITE = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The folded words of a text, about _PIECE bytes of them at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def _counted(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the shingles joined[start:end] have each bit, the highest first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _HASHES):
        a, b = starts[i : i + _HASHES].tolist(), ends[i : i + _HASHES].tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a, b)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    total, n, carry = np.zeros(64, np.int64), 0, []
    for words in _pieces(text or b""):
        words = carry + words
        if len(words) >= k:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            total += _counted(b" ".join(words), starts[: len(words) - k + 1], ends[k - 1 :])
            n += len(words) - k + 1
        carry = words[-(k - 1) :] if k > 1 else []
    if not n and carry:
        whole = b" ".join(carry)
        total, n = _counted(whole, np.array([0]), np.array([len(whole)])), 1
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, f) of each row, f being the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.fromiter((fingerprint(x.as_py(), k) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, f bigint")


def segment(f: Column, a: int, b: int) -> Column:
    """Bits a to b (from the lowest) of f."""
    return F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def variants(f: Column, parts: tuple = SEGMENTS) -> Column:
    """The keys of a fingerprint: for each bit, the number of the bit and its segment without it."""
    key = lambda p, a, b: segment(f, a, b).bitwiseAND(F.lit(~(1 << (p - a)))).bitwiseOR(F.lit(p << 32))
    return F.array(*(key(p, a, b) for a, b in parts for p in range(a, b)))


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def _reached(f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join every component of the distinct fingerprints f, a link a member at most."""
    out, left = [], f
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            hit = _near(block[:, None], left[None], bits)
            got = hit.any(0)
            out.append((block[hit[:, got].argmax(0)], left[got]))
            front, left = np.concatenate([front, left[got]]), left[~got]
    empty = np.zeros(0, np.uint64)
    return tuple(np.concatenate([empty, *(x[i] for x in out)]) for i in (0, 1))  # type: ignore[return-value]


def grouped_links(rows: DataFrame, bits: int, few: int) -> DataFrame:
    """Links (a, b) within the groups of equal key of rows (key, f), which come sorted by key. A task holds a batch and one group."""

    def found(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = np.repeat(end - begin, end - begin)
        a, b = [], []
        for d in range(1, min(few, int(size.max(initial=1)))):
            i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= few))
            i = i[_near(f[i], f[i + d], bits)]
            a.append(f[i])
            b.append(f[i + d])
        for i in np.flatnonzero(end - begin > few):
            x, y = _reached(f[begin[i] : end[i]], bits)
            a.append(x)
            b.append(y)
        empty = [np.zeros(0, np.uint64)]
        x, y = np.concatenate(empty + a), np.concatenate(empty + b)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the group that is open: later batches may continue it
        for batch in batches:
            key, f = (batch.column(c).to_numpy() for c in ("key", "f"))
            if not len(key):
                continue
            if held and held[0][0][0] != key[0]:
                yield found(*(np.concatenate(x) for x in zip(*held)))
                held = []
            last = int(np.searchsorted(key, key[-1]))
            if last:
                held.append((key[:last], f.view(np.uint64)[:last]))
                yield found(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((key[last:].copy(), f.view(np.uint64)[last:].copy()))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("key", "f").mapInArrow(run, "a bigint, b bigint")


def point_links(classes: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that join every component of fingerprints (f): each to the least of those at a point within bits / 2 of both."""
    masks = [0] + [1 << i for i in range(64)] * (bits >= 2) + [1 << i | 1 << j for i in range(64) for j in range(i)] * (bits >= 4)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    points = classes.select("f", F.explode(F.lit(signed).cast("array<bigint>")).alias("m")).select("f", F.col("f").bitwiseXOR(F.col("m")).alias("p"))
    least = points.groupBy("p").agg(F.min("f").alias("least"), F.max("f").alias("most")).where("least < most").select("p", "least")
    return points.join(least.hint("merge"), "p").where("f <> least").select(F.col("f").alias("a"), F.col("least").alias("b")).distinct()


def links(classes: DataFrame, bits: int = BITS, few: int = FEW, many: int = MANY) -> DataFrame:
    """Links (a, b) that join every component of distinct fingerprints (f)."""
    if bits // len(SEGMENTS) > 1 or bits not in (2, 4):
        raise ValueError("bits must be 2 or 4: one of three segments then differs in one bit at most")
    parts = F.array(*(F.struct(F.lit(i).alias("i"), segment(F.col("f"), a, b).alias("v")) for i, (a, b) in enumerate(SEGMENTS)))
    held = classes.select(F.explode(parts).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("c")).where(f"c > {many} / 2")
    heavy = materialise(held.select("i", "v"), "heavy")
    rows = classes.select(F.explode(variants(F.col("f"))).alias("key"), "f")
    if heavy.isEmpty():
        hot = None
    else:
        around = F.coalesce(*(F.when(F.col("i") == i, variants(F.shiftleft("v", a), ((a, b),))) for i, (a, b) in enumerate(SEGMENTS)))
        keys = heavy.select(F.explode(around).alias("key")).distinct().withColumn("hot", F.lit(True))
        marked = materialise(rows.join(keys.hint("merge"), "key", "left"), "variants")
        hot, rows = marked.where("hot").select("f").distinct(), marked.where("hot is null")
    near = grouped_links(rows.repartition("key").sortWithinPartitions("key"), bits, few)
    return near if hot is None else near.union(point_links(hot, bits))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, few: int = FEW, many: int = MANY) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialise(rows.where("doc_id is not null").groupBy("f").agg(F.min("doc_id").alias("rep")), "classes")
    comp = components(links(classes.select("f"), bits, few, many))
    named = classes.join(comp.withColumnRenamed("node", "f"), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    whole = materialise(named.select("f", "comp").join(least.hint("merge"), "comp").select("f", "component_id"), "components")
    out = rows.join(whole.hint("merge"), "f", "left")
    digits = F.lpad(F.lower(F.hex("f")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
