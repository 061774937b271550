"""Near-duplicate documents by SuperMinHash, banding, exact verification and distributed union-find.

A document's set is its distinct k-word shingles (words folded A-Z to a-z; with fewer than k words
the whole sequence is the one shingle; none without words). Equal sets are one class, and only
classes are compared. SuperMinHash gives register p of a signature the least value of
j + r over the set's elements, j being the step at which an element's own random permutation
reaches p: ranks of one element are correlated, which lowers the variance, and an element stops as soon
as its step exceeds every register. Signatures of BANDS x ROWS registers are cut into bands; classes that share a band
are candidates; a pair is linked where 100 * |A & B| >= threshold * |A | B| on the full sets.

No bucket is expanded into its pairs. First every class is tested against the least of its buckets' leaders only, and links are
merged into components; then against its other leaders where these lie in other components. For the classes of buckets that
still hold several components the rest is found exactly, by their shingles in order of frequency, rarest first: two near sets of n and
m <= n shingles share one of the first n - ceil(3n/4) + 1 of the one and of the first m - ceil(6m/7) + 1 of the other, with enough
shingles left behind it (prefix, length and positional filters). These tests are made first against counts by (shingle, component,
size), so that a member that can't reach a large component is not paired with its members. So nothing is capped, and copies that all
hold the same frequent shingles give no pairs.
Pairs whose signatures (a byte a register) agree in under ``AGREE`` of the registers are not near: at a similarity of 0.75 that is 6 standard
deviations off (1e-9), far less than what banding itself misses. Of the others, the one that agrees most speaks first for each two
components, and the rest are tested only where these two are still apart. Whole texts travel for those pairs alone.
At a similarity of 0.75 a pair shares no band with probability (1 - 0.75**4)**28 = 2.4e-5.

Defined results: null or empty texts have n_shingles 0 and are their own component; repeated rows
fall in one class; rows that repeat an id with another text each get the component of their own text, and where that id is the
smallest of several classes these are one node; a row with a null id has component null and is kept, and links nothing;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import components, materialise, ready
from ._text import blocks, mix, shingle_sets, words_of

BANDS, ROWS, SHINGLE, AGREE = 28, 4, 5, 0.5
_MOST = 1 << 17  # elements whose permutations are held at once


def super_minhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (len(sets) x m, uint64: step in the top byte, the random part below) of sets of 64-bit hashes."""
    sig = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return sig.reshape(0, m)
    x = np.concatenate(sets).astype(np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(x), _MOST):
        e, d = x[at : at + _MOST], owner[at : at + _MOST]
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
        live = np.arange(len(e))
        first, last = d[0], d[-1] + 1
        for j in range(m):
            worst = (sig[first * m : last * m].reshape(-1, m).max(1) >> np.uint64(56)).astype(np.int64)
            live = live[worst[d[live] - first] >= j]
            if not len(live):
                break
            h = mix(e[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            place = perm[live, k]
            perm[live, k] = perm[live, j]
            value = (mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(8)) | np.uint64(j << 56)
            np.minimum.at(sig, d[live] * m + place, value)
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    x = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (len(sig), bands))
    for r in range(rows):
        key = mix(key ^ x[:, :, r]) * np.uint64(0x165667B19E3779F9)
    return mix(key)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, f1, f2, keys, sketch): set size, fingerprint of the set, band keys (none for an empty set), a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                h, bounds = words_of(texts[a:b])[:2]
                sets = shingle_sets(h, bounds, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                sig = super_minhash(sets)
                keys = band_keys(sig)[n > 0].astype(np.int64)
                sketch = pa.Array.from_buffers(pa.binary(BANDS * ROWS), len(sets), [None, pa.py_buffer(sig.astype(np.uint8).tobytes())])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                f1 = np.array([np.add.reduce(mix(s + np.uint64(1))) if len(s) else 0 for s in sets], np.uint64)
                f2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(2))) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n), pa.array(f1.astype(np.int64)), pa.array(f2.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())),
                        sketch.cast(pa.binary()),
                    ],
                    ["doc_id", "n", "f1", "f2", "keys", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, sketch binary")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b, ...) whose signatures agree in AGREE of the registers or more, with the number of them (agree). classes: (rep, sketch)."""
    mine = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")).hint("merge")
    both = pairs.join(mine("b"), "b").join(mine("a"), "a").select(*pairs.columns, "sa", "sb")
    m, schema = BANDS * ROWS, ", ".join(f"{c} bigint" for c in (*pairs.columns, "agree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, m) for c in ("sa", "sb"))
            n = (x == y).sum(1)
            out = batch.drop_columns(["sa", "sb"]).append_column("agree", pa.array(n.astype(np.int64)))
            yield out.filter(pa.array(n >= AGREE * m))

    return both.mapInArrow(run, schema)


def by_prefixes(left: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame:
    """Pairs (a, b, ca, cb) of classes (rep, comp) of different components that may be near, none of the near ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                h, bounds = words_of(texts[a:b])[:2]
                sets = shingle_sets(h, bounds, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                at = pa.array(np.repeat(np.arange(a, b), n))
                cols = [*(batch.column(j).take(at) for j in (0, 1, 3)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "comp", "t", "n", "s"])

    texts = docs.join(left.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "comp", "text").dropDuplicates(["doc_id", "text"])
    texts = texts.withColumn("t", F.xxhash64("text"))  # an id may have several texts
    held = materialise(texts.mapInArrow(run, "rep bigint, comp bigint, t bigint, n bigint, s bigint"), "shingles")
    often = held.groupBy("s").agg(F.count("*").alias("often"))
    w = Window.partitionBy("rep", "t").orderBy("often", "s")
    ranked = held.join(often.hint("merge"), "s").withColumn("p", F.row_number().over(w))
    ranked = materialise(ranked.where(f"p <= n - ceil({threshold} * n / 100) + 1").drop("often"), "prefixes")
    need = f"ceil({threshold} * (nx + ny) / {100 + threshold})"
    fits = f"cx <> cy and ny <= nx and 100 * ny >= {threshold} * nx and 1 + least(nx - px, room) >= {need}"
    probe = ranked.selectExpr("s", "rep as x", "comp as cx", "n as nx", "p as px")
    index = ranked.where(f"p <= n - ceil(2 * {threshold} * n / {100 + threshold}) + 1").selectExpr("s", "rep as y", "comp as cy", "n as ny", "n - p as room")
    groups = index.groupBy("s", "cy", "ny").agg(F.max("room").alias("room"))
    some = probe.join(groups.hint("merge"), "s").where(fits).drop("room")
    pairs = some.join(index.hint("merge"), ["s", "cy", "ny"]).where(fits)
    return pairs.selectExpr("x as a", "y as b", "cx as ca", "cy as cb")


def verify(pairs: DataFrame, docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full shingle sets reach the threshold. docs: (doc_id, text)."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialise(docs.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # rows of one leader mostly follow each other
        for batch in batches:
            ia, ib = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ta, tb, ok = batch.column(2), batch.column(3).to_pylist(), np.zeros(len(ia), bool)
            for p, q in blocks(tb):
                h, bounds = words_of(tb[p:q])[:2]
                for i, s in enumerate(shingle_sets(h, bounds, SHINGLE), p):
                    text = ta[i].as_py()
                    if last[0] != text:
                        h2, bounds2 = words_of([text])[:2]
                        last = (text, shingle_sets(h2, bounds2, SHINGLE)[0])
                    common = len(np.intersect1d(last[1], s, assume_unique=True))
                    ok[i] = common > 0 and 100 * common >= threshold * (len(last[1]) + len(s) - common)
            yield pa.RecordBatch.from_arrays([pa.array(ia[ok]), pa.array(ib[ok])], ["a", "b"])

    return materialise(both.mapInArrow(run, "a bigint, b bigint"), "links")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept (it is its component's smallest)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sig = materialise(signatures(docs, id_col, text_col), "signatures")
    classes = materialise(
        sig.where("n > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "classes",
    )
    sketches = classes.select("rep", "sketch")
    entries = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("lead"))
    shared = shared.where("members > 1").select("key", "members", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"))
    bucket = materialise(entries.join(shared.hint("merge"), "key"), "buckets")

    def close(n: str, m: str) -> str:
        return f"100 * least({n}, {m}) >= {threshold} * greatest({n}, {m})"

    pairs = bucket.where(f"rep <> lead and {close('n', 'lead_n')}").groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a"))
    tested = materialise(pairs.select("a", "b"), "pairs")
    comp = components(verify(agreeing(tested, sketches).select("a", "b"), rows, threshold))

    def joined(x: DataFrame, end: str, name: str) -> DataFrame:
        """x with the component of the class in column end."""
        known = comp.select(F.col("node").alias(end), F.col("comp").alias(name)).hint("merge")
        return x.join(known, end, "left").withColumn(name, F.coalesce(name, end))

    def link(found: DataFrame) -> bool:
        """Tests the pairs (a, b) whose components differ; whether any is a link."""
        nonlocal comp
        apart = joined(joined(found.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        apart = materialise(apart, "pairs")
        if apart.isEmpty():
            return False
        more = verify(apart, rows, threshold)
        if more.isEmpty():
            return False
        comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
        return True

    def test(fresh: DataFrame) -> None:
        """Tests the pairs (a, b, ca, cb), for each two components first the one whose signatures agree most."""
        nonlocal tested
        fresh = materialise(fresh.distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return
        tested = tested.union(fresh.select("a", "b"))
        found = materialise(agreeing(fresh, sketches), "agreeing")
        best = found.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b")
        best = materialise(best, "best")
        link(best)
        link(found.select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti"))

    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
    others = bucket.where(f"rep <> lead and {close('n', 'lead_n')}").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    test(joined(joined(others, "a", "ca"), "b", "cb").where("ca <> cb").select(*ends))
    now = joined(bucket.select("key", "rep"), "rep", "comp")
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = materialise(now.join(open_.hint("merge"), "key").select("rep", "comp").distinct(), "open")
    if not left.isEmpty():
        test(by_prefixes(left, rows, threshold).select(*ends))
    named = classes.join(comp, classes.rep == comp.node, "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"),
        F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are not their component's smallest; rows that repeat a kept id stay one row."""
    drop = materialise(cluster(docs, id_col, text_col).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(drop.withColumnRenamed("doc_id", "__drop"), F.col(id_col) == F.col("__drop"), "left_anti")
