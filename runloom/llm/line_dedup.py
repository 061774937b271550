"""Line dedup by a deletion-neighbourhood join: a line goes when an equal or nearly equal line stands earlier.

Lines are cut at \\n and compared by their folded words. Two lines are near when they are equal, or when one insertion, deletion or
replacement of a word turns one into the other and each word taken out or replaced holds at most ``SHARE`` of the bytes of its line's
words. So the bound follows the length at every length. Order is by (doc_id, line number).

A line emits the hash of its words and of all variants within the bound: itself with one such word deleted. Lines of one length are one
replacement apart exactly where they share a variant with the same place deleted; a line is one deletion from another where a variant
of the longer equals the whole shorter one. So the earliest line of a key decides for all others of it, and no pairs within a group
are made. Candidates are verified by their words. Variants are emitted only for distinct lines that share their first or last half
with another distinct line: one edit leaves the first or the last half of the shorter line unchanged, so nothing is lost.

Joins are sort-merge joins whatever the sizes, so that Spark can split a very common line or variant and the plan is the same at every size.

Defined results: blank lines stay; a null text stays null; rows with a null id keep all lines and take none from others; rows that
repeat both id and text are cleaned alike, by what other rows hold; rows that repeat an id with another text are rows of their own; other
columns are passed through, but for n_lines and n_dropped where counts are asked for; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, ready
from ._text import _powers, blocks, hash_words, mix

SHARE = 0.15
_B, _C = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BINV = pow(_B, -1, 1 << 64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Lines:
    """Lines of all texts: owner, number in it, first and past word (lo, hi), bounds in data; word hashes summed with powers; word sizes."""

    def __init__(self, texts: list[bytes | None]):
        joined = b"\n".join(t or b"" for t in texts)
        self.data = np.frombuffer(joined, np.uint8)
        h, s, e = hash_words(self.data)
        self.ends = np.concatenate([np.flatnonzero(self.data == 10), [len(self.data)]])
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        size = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        begin = np.cumsum(size) - size
        self.owner = np.searchsorted(begin, self.starts, "right") - 1
        self.number = np.arange(len(self.starts)) - np.searchsorted(self.starts, begin)[self.owner]
        self.lo, self.hi = np.searchsorted(s, self.starts), np.searchsorted(s, self.ends)
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(_B, "p", len(h))[: len(h)], out=self.total[1:])
        self.size = e - s

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a to b."""
        inv = _powers(_BINV, "q", len(self.total))
        return mix((self.total[b] - self.total[a]) * inv[a] + (b - a).astype(np.uint64) * _C)

    def keep(self, use: np.ndarray) -> None:
        for name in ("starts", "ends", "owner", "number", "lo", "hi"):
            setattr(self, name, getattr(self, name)[use])

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash) of each line without one word that is small enough."""
        w = self.hi - self.lo
        line = np.repeat(np.arange(len(w)), w)
        word = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + self.lo[line]
        upto = np.concatenate([[0], np.cumsum(self.size)])
        small = self.size[word] <= SHARE * (upto[self.hi] - upto[self.lo])[line]
        line, word = line[small], word[small]
        a, b, inv = self.lo[line], self.hi[line], _powers(_BINV, "q", len(self.total) + 1)
        left = (self.total[word] - self.total[a]) * inv[a]
        right = (self.total[b] - self.total[word + 1]) * inv[a + 1]
        return line, word - a, mix(left + right + (b - a - 1).astype(np.uint64) * _C)


def lines(docs: DataFrame) -> DataFrame:
    """(d, t, q, h, keys) of each line with words: id and hash of the text, number, hash of the words, half keys. docs: (d, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                x = _Lines(texts[a:b])
                x.keep(x.hi > x.lo)
                lo, hi, w = x.lo, x.hi, x.hi - x.lo
                half, less = np.maximum(1, w // 2), np.maximum(1, (w - 1) // 2)
                salt = lambda n, side: mix(n.astype(np.uint64) * np.uint64(2) + np.uint64(side))
                ends = [(half, lo, lo + half, 0), (half, hi - half, hi, 1), (less, lo, lo + less, 0), (less, hi - less, hi, 1)]
                keys = np.stack([x.span(i, j) ^ salt(n, side) for n, i, j, side in ends], axis=1)
                n = np.where(half == less, 2, 4)
                flat = keys[np.arange(4)[None] < n[:, None]]
                at = pa.array(x.owner + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number.astype(np.int32)),
                        pa.array(x.span(lo, hi).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.astype(np.int64))),
                    ],
                    ["d", "t", "q", "h", "keys"],
                )

    return docs.mapInArrow(run, "d bigint, t bigint, q int, h bigint, keys array<bigint>")


def line_texts(docs: DataFrame) -> DataFrame:
    """(d, t, q, h, line) of each line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                x = _Lines(texts[a:b])
                use = x.hi > x.lo
                cuts = np.concatenate([x.starts, [len(x.data) + 1]]).astype(np.int32)  # a line with the \n behind it
                whole = pa.Array.from_buffers(pa.binary(), len(x.starts), [None, pa.py_buffer(cuts), pa.py_buffer(x.data.tobytes() + b"\n")])
                x.keep(use)
                at = pa.array(x.owner + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number.astype(np.int32)),
                        pa.array(x.span(x.lo, x.hi).astype(np.int64)), whole.filter(pa.array(use)),
                    ],
                    ["d", "t", "q", "h", "line"],
                )

    return docs.mapInArrow(run, "d bigint, t bigint, q int, h bigint, line binary")


def variants(rows: DataFrame) -> DataFrame:
    """(v, p, h, d, q, t): hash of each line (h, d, q, t, line) with the word p deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.rstrip(b"\n") for x in batch.column(4).to_pylist()]
            for a, b in blocks(texts):
                line, place, v = _Lines(texts[a:b]).variants()
                cols = [pa.array(v.astype(np.int64)), pa.array(place.astype(np.int32))]
                at = pa.array(line + a)
                yield pa.RecordBatch.from_arrays([*cols, *(batch.column(j).take(at) for j in range(4))], ["v", "p", "h", "d", "q", "t"])

    return rows.select("h", "d", "q", "t", "line").mapInArrow(run, "v bigint, p int, h bigint, d bigint, q int, t bigint")


def near(x: bytes, y: bytes) -> bool:
    """Whether two lines are equal or one edit within the bound apart."""
    a, b = x.translate(_LOWER).split(), y.translate(_LOWER).split()
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return a == b
    same = len(a) == len(b)
    at = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    fits = lambda word, line: len(word) <= SHARE * sum(map(len, line))
    return a[at + 1 :] == b[at + same :] and fits(a[at], a) and (not same or fits(b[at], b))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (h, by) of line hashes whose lines are near. texts: (h, line), a hash once."""
    both = pairs.join(texts.select("h", F.col("line").alias("x")).hint("merge"), "h")
    both = both.join(texts.select(F.col("h").alias("by"), F.col("line").alias("y")).hint("merge"), "by").select("h", "by", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [near(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["h", "by"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "h bigint, by bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, drop): documents (id and hash of the text) that lose lines, and the sorted numbers (from 0) of these lines."""
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    rows = rows.where("d is not null and text is not null")
    every = materialise(lines(rows), "lines")
    distinct = every.groupBy("h").agg(F.min(F.struct("d", "q", "t")).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    distinct = materialise(distinct.select("h", "at.d", "at.q", "at.t", "n", "keys"), "distinct")
    half = distinct.select("h", F.explode("keys").alias("key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    some = half.join(shared.hint("merge"), "key", "left_semi").select("h").distinct()
    some = materialise(distinct.select("h", "d", "q", "t").join(some.hint("merge"), "h", "left_semi"), "halves")
    found = line_texts(rows).join(some.hint("merge"), ["h", "d", "q", "t"]).dropDuplicates(["h"])
    found = materialise(found.select("h", "d", "q", "t", "line"), "texts")
    one = materialise(variants(found), "variants")
    own = F.struct("d", "q", "t", "h")
    lead = one.groupBy("v", "p").agg(F.min(own).alias("e"), F.count("*").alias("c")).where("c > 1").select("v", "p", F.col("e.h").alias("by"))
    swapped = one.select("v", "p", "h").join(lead.hint("merge"), ["v", "p"]).where("h <> by").select("h", "by")
    whole = found.select(F.col("h").alias("v"), own.alias("b"))
    cut = one.select("v", own.alias("a")).join(whole.hint("merge"), "v").select("a", "b")
    cut = materialise(cut, "cuts")
    longer = cut.where("b < a").select(F.col("a.h").alias("h"), F.col("b.h").alias("by"))
    shorter = cut.groupBy("b").agg(F.min("a").alias("a")).where("a < b").select(F.col("b.h").alias("h"), F.col("a.h").alias("by"))
    pairs = materialise(swapped.union(longer).union(shorter).distinct(), "candidates")
    close = verify(pairs, found).select("h").distinct().withColumn("near", F.lit(True))
    flagged = distinct.join(close.hint("merge"), "h", "left").where("n > 1 or near")
    flagged = flagged.select(
        "h", F.col("d").alias("fd"), F.col("q").alias("fq"), F.col("t").alias("ft"), F.coalesce("near", F.lit(False)).alias("near")
    )
    gone = every.select("d", "t", "q", "h").join(flagged.hint("merge"), "h").where("near or d <> fd or q <> fq or t <> ft")
    return gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("q")).alias("drop"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text_col; with counts, also n_lines and n_dropped."""
    drop = materialise(repeats(docs, id_col, text_col), "drop").select(
        F.col("d").alias("__id"), F.col("t").alias("__text"), F.col("drop").alias("__drop")
    )
    text = F.col(text_col).cast("string")
    mine = (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(text) == F.col("__text"))
    out = docs.join(drop.hint("merge"), mine, "left")
    line = F.split(text, "\n", -1)
    keep = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__drop"))
    left = F.transform(F.array(line), lambda x: F.array_join(F.transform(keep(x), lambda i: x[i]), "\n"))[0]
    clean = F.when(F.col("__drop").isNull(), text).otherwise(left).alias(text_col)
    extra = ("n_lines", "n_dropped") if counts else ()
    cols = [clean if c == text_col else F.col(c) for c in docs.columns if c not in extra]
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.size(line))
        cols += [n.cast("bigint").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint").alias("n_dropped")]
    return out.select(*cols)
