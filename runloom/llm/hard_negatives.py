"""Hard negatives for contrastive training by branch and bound over ball trees.

Rows are vectors of whole numbers (``quantised``) with a label; the score of a row for an anchor is their inner product. An anchor's positives are its
first ``positives`` other rows of its label, and for each positive the negatives are the first ``negatives`` rows of other labels whose score lies in a window beneath the
positive's. Higher scores come first, ties by the smaller id.

Every task builds ball trees over at most ``TREE_BYTES`` of its rows (labels first, then halves along the line between two far members, down to leaves of ``LEAF``) and
writes them as a table: the index, read by all later jobs. For an anchor q a node with centre c and radius r holds scores in q.c - |q| r to
q.c + |q| r only. It is pruned where its labels can't fit, where even its highest score lies strictly beneath the current k-th (a tie may still win by its
id) or beneath the window, or where even its lowest lies above the window. A k-th is kept for each anchor (and window) over all trees of a task.
Nothing else is left out, so the result is exact; on vectors without structure few nodes are pruned and the work is that of a scan in blocks.

Anchors go in blocks of at most ``BLOCK_BYTES`` and ``BLOCK`` of them on average, dealt by a hash; a block's vectors and windows are the only thing that is broadcast or that passes the
driver. Each block reads the index twice, for positives and for negatives, and a task returns at most k rows for each of its anchors and windows. Blocks are written
one by one to the shared folder, so a lost executor costs its tasks only. Rows are never gathered by label or anchor, so a label that a third
of all rows have costs what others cost.

Sums are exact: 32-bit floats where norms bound every partial sum by 2**24, 64-bit ones below 2**53, whole numbers beyond. A score that does not fit in 64 bits is an error.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a vector shorter than another counts as filled up with zeros; a null
id counts as larger than any other (as 2**63 - 1) and is null in the result; rows that repeat an id are rows of their own, as anchors and as candidates; an anchor without positives, and a positive without negatives in
its window, gives no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, new_path, ready

LEAF, TREE_BYTES = 128, 8 << 20
BLOCK, BLOCK_BYTES = 4096, 8 << 20
NO_ID = (1 << 63) - 1
_INDEX = (
    "tree bigint, dims int, width int, reach double, ids array<bigint>, labels array<bigint>, anchors array<boolean>, vectors binary, first array<int>,"
    " past array<int>, skip array<int>, low array<bigint>, high array<bigint>, radius array<double>, centres array<double>"
)
_ANCHORS = "key bigint, id bigint, label bigint, dims int, vector binary"
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles; null where the vector, or a component, is null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(vector, fine), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")))


def build(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """(order, nodes) of a ball tree: nodes (first, past, skip, low, high, radius, centre) in pre-order, skip being the node behind its branch."""
    order, nodes = np.argsort(labels, kind="stable"), []
    stack: list[tuple[int, int, int]] = [(0, len(order), -1)]
    while stack:
        a, b, closes = stack.pop()
        if closes >= 0:
            nodes[closes][2] = len(nodes)
            continue
        x, own = vectors[order[a:b]].astype(np.float64), labels[order[a:b]]
        centre = x.mean(0)
        away = np.sqrt(((x - centre) ** 2).sum(1))
        nodes.append([a, b, 0, own.min(), own.max(), away.max(), centre])
        stack.append((0, 0, len(nodes) - 1))
        if b - a <= leaf:
            continue
        if own[0] != own[-1]:  # a change of label near the middle
            change = np.flatnonzero(np.diff(own)) + 1
            cut = a + int(change[np.abs(change - (b - a) // 2).argmin()])
        else:
            one = x[away.argmax()]
            two = x[((x - one) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argsort(x @ (two - one), kind="stable")]
            cut = (a + b) // 2
        stack += [(cut, b, -1), (a, cut, -1)]
    return order, nodes


def index(rows: DataFrame, leaf: int = LEAF, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Trees over rows (id, label, vector as doubles, anchor), one a row of _INDEX."""

    def tree(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        lists = t.column("vector").chunk(0)
        size = lists.value_lengths().to_numpy()
        d = max(1, int(size.max()))
        x = np.zeros((len(lists), d))
        x[np.arange(d)[None] < size[:, None]] = lists.flatten().to_numpy()
        if np.abs(x).max() >= 2**62:
            raise OverflowError("a component does not fit in 62 bits")
        width = 2 if np.abs(x).max() < 2**15 else 8
        ids, labels = (t.column(c).to_numpy() for c in ("id", "label"))
        order, nodes = build(x, labels, leaf)
        packed = x[order].astype(np.int16 if width == 2 else np.int64)
        norm = float(np.sqrt((x**2).sum(1)).max())
        first, past, skip, low, high, radius = (np.array([n[i] for n in nodes]) for i in range(6))
        one = lambda v: pa.array([v.tolist()])
        cols = [
            pa.array([number]), pa.array([d], pa.int32()), pa.array([width], pa.int32()), pa.array([norm]), one(ids[order]), one(labels[order]),
            one(t.column("anchor").to_numpy()[order]), pa.array([packed.tobytes()]), *(one(v).cast(pa.list_(pa.int32())) for v in (first, past, skip)), one(low), one(high),
            one(radius), one(np.concatenate([n[6] for n in nodes])),
        ]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, number = 0, TaskContext.get().partitionId() << 20  # the same in every attempt of a task
        for batch in batches:
            sizes = [8 * max(1, k) for k in batch.column("vector").value_lengths().to_pylist()]
            at = 0
            for i, size in enumerate(sizes):
                total += size
                if total >= tree_bytes:
                    yield tree([*held, batch.slice(at, i + 1 - at)], number)
                    held, total, number, at = [], 0, number + 1, i + 1
            if at < len(sizes):
                held.append(batch.slice(at))
        if held:
            yield tree(held, number)

    return rows.mapInArrow(run, _INDEX)


def _key(tree: int, place: np.ndarray | int):
    """A number for each row of the index: a tree has fewer than 2**21 rows."""
    return (tree << 21) + place


def _whole(width: int, vectors: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(vectors, np.int16 if width == 2 else np.int64).reshape(-1, dims)


def anchors_of(trees: DataFrame) -> DataFrame:
    """(key, id, label, dims, vector) of the rows that are anchors, vector as 64-bit whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                at = np.flatnonzero(t["anchors"])
                x = _whole(t["width"], t["vectors"], t["dims"])[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_key(t["tree"], at)), pa.array(np.array(t["ids"], np.int64)[at]), pa.array(np.array(t["labels"], np.int64)[at]),
                        pa.array([t["dims"]] * len(at), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary()),
                    ],
                    ["key", "id", "label", "dims", "vector"],
                )

    return trees.select("tree", "dims", "width", "ids", "labels", "anchors", "vectors").mapInArrow(run, _ANCHORS)


class Search:
    """The first k rows of each anchor and window over the trees that visit() gets. windows: lowest and highest score (n x windows)."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.keys, self.labels, self.q, self.low, self.high, self.k, self.same = keys, labels, vectors, low, high, k, same
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.score = np.full((*low.shape, k), np.iinfo(np.int64).min)
        self.id = np.full((*low.shape, k), NO_ID)
        self.filled = np.zeros(low.shape, np.int64)
        self.floor = low.copy()  # a row beneath it can't be among the first k: the window's end or, once there are k rows, the k-th

    def visit(self, t: dict) -> None:
        d = t["dims"]
        x, q = _whole(t["width"], t["vectors"], d), self.q
        if q.shape[1] != d:  # what one of the two lacks is zero
            q = np.pad(q, ((0, 0), (0, max(0, d - q.shape[1]))))[:, :d]
        bound = t["reach"] * self.norm.max(initial=0)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        ids, labels, own = np.array(t["ids"], np.int64), np.array(t["labels"], np.int64), _key(t["tree"], np.arange(len(x)))
        x, q = x.astype(kind), q.astype(kind)
        centres = np.array(t["centres"]).reshape(-1, d)
        middle = q.astype(np.float64) @ centres.T
        reach = self.norm[:, None] * (np.array(t["radius"]) + 1e-9 * np.sqrt((centres**2).sum(1)))[None] * (1 + 1e-9) + 1e-6
        least, most = middle - reach, middle + reach
        if max(least.max(initial=0), -most.min(initial=0)) >= 2**63:
            raise OverflowError("a score does not fit in 64 bits")
        first, past, skip, low, high = (t[c] for c in ("first", "past", "skip", "low", "high"))
        active = [(len(first), np.arange(len(q)))]  # (node at which a branch ends, its anchors)
        i = 0
        while i < len(first):
            while active[-1][0] <= i:
                active.pop()
            a = active[-1][1]
            fits = (self.labels[a] >= low[i]) & (self.labels[a] <= high[i]) if self.same else (self.labels[a] != low[i]) | (low[i] != high[i])
            a = a[fits & ((most[a, i, None] >= self.floor[a]) & (least[a, i, None] <= self.high[a])).any(1)]
            if not len(a):
                i = skip[i]
                continue
            if skip[i] > i + 1:
                active.append((skip[i], a))
            else:
                rows = slice(first[i], past[i])
                self._leaf(a, (q[a] @ x[rows].T), ids[rows], labels[rows], own[rows])
            i += 1

    def _leaf(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: np.ndarray) -> None:
        if score.dtype == object and score.size and max(abs(v) for v in score.flat) >= 2**63:
            raise OverflowError("a score does not fit in 64 bits")
        score = score.astype(np.int64)
        fits = (self.labels[a, None] == labels[None]) == self.same
        fits &= self.keys[a, None] != own[None]
        hit = fits[:, None] & (score[:, None] >= self.floor[a, :, None]) & (score[:, None] <= self.high[a, :, None])
        at, w, j = np.nonzero(hit)
        if not len(at):
            return
        n_w = self.low.shape[1]
        cell = a[at] * n_w + w
        touched = np.unique(cell)
        have = np.arange(self.k)[None] < self.filled.reshape(-1)[touched, None]
        cells = np.concatenate([cell, np.repeat(touched, have.sum(1))])
        scores = np.concatenate([score[at, j], self.score.reshape(-1, self.k)[touched][have]])
        every = np.concatenate([ids[j], self.id.reshape(-1, self.k)[touched][have]])
        order = np.lexsort((every, -scores, cells))
        cells, scores, every = cells[order], scores[order], every[order]
        begin = np.searchsorted(cells, touched)
        rank = np.arange(len(cells)) - np.repeat(begin, np.diff([*begin, len(cells)]))
        keep = rank < self.k
        cells, scores, every, rank = cells[keep], scores[keep], every[keep], rank[keep]
        self.score.reshape(-1, self.k)[cells, rank], self.id.reshape(-1, self.k)[cells, rank] = scores, every
        self.filled.reshape(-1)[touched] = np.bincount(np.searchsorted(touched, cells), minlength=len(touched))
        full = touched[self.filled.reshape(-1)[touched] == self.k]
        flat = self.floor.reshape(-1)
        flat[full] = np.maximum(flat[full], self.score.reshape(-1, self.k)[full, -1])

    def found(self) -> pa.RecordBatch:
        a, w, r = np.nonzero(np.arange(self.k)[None, None] < self.filled[:, :, None])
        cols = [self.keys[a], w.astype(np.int32), self.id[a, w, r], self.score[a, w, r]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "w", "id", "score"])


def search(trees: DataFrame, queries: tuple, k: int, same: bool) -> DataFrame:
    """(key, w, id, score, rank) of the first k rows of each anchor and window. queries: what Search takes first, of one block."""
    spread = trees.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(*spread.value, k, same)
        for batch in batches:
            for i in range(batch.num_rows):
                s.visit(batch.slice(i, 1).to_pylist()[0])
        yield s.found()

    found = trees.mapInArrow(run, "key bigint, w int, id bigint, score bigint")
    w = Window.partitionBy("key", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
    at_least: int = 80, at_most: int = 100, scale: int = 256, leaf: int = LEAF, tree_bytes: int = TREE_BYTES, block: int = BLOCK,
) -> DataFrame:
    """SCHEMA of rows for which anchor holds: negatives with at_least * p <= 100 * score <= at_most * p for a positive's score p, ranked from 1."""
    spark = ready(rows.sparkSession)
    own = rows.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("bigint").alias("label"),
        quantised(F.col(vector_col), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("label is not null and vector is not null")
    trees = materialise(index(own, leaf, tree_bytes), "trees")
    asked = materialise(anchors_of(trees), "anchors")
    n, dims = asked.agg(F.count("*"), F.max("dims")).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    blocks = -(-n // max(1, min(block, BLOCK_BYTES // (8 * dims))))
    dealt, out = new_path(spark, "blocks"), new_path(spark, "negatives")
    asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).write.partitionBy("block").parquet(dealt)
    by_block = spark.read.schema(f"{_ANCHORS}, block bigint").parquet(dealt)
    for b in range(blocks):
        mine_ = by_block.where(F.col("block") == b).drop("block").orderBy("key").collect()  # one block
        if not mine_:
            continue
        keys, labels = (np.array([r[c] for r in mine_], np.int64) for c in ("key", "label"))
        q = np.zeros((len(mine_), dims), np.int64)
        for i, r in enumerate(mine_):
            q[i, : r["dims"]] = np.frombuffer(r["vector"], np.int64)
        every = np.iinfo(np.int64)
        whole = (np.full((len(q), 1), every.min), np.full((len(q), 1), every.max))
        close = materialise(search(trees, (keys, labels, q, *whole), positives, True), "positives")
        low, high = np.full((len(q), positives), every.max), np.full((len(q), positives), every.min)  # windows that hold nothing
        for r in close.collect():  # at most positives rows for each anchor of the block
            i, p = int(np.searchsorted(keys, r["key"])), r["score"]
            low[i, r["rank"] - 1], high[i, r["rank"] - 1] = max(every.min, -(-at_least * p // 100)), min(every.max, at_most * p // 100)
        far = search(trees, (keys, labels, q, low, high), negatives, False)
        named = by_block.where(F.col("block") == b).select("key", F.col("id").alias("anchor_id"))
        ps = close.select("key", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        both = far.join(ps, ["key", "w"]).join(named, "key")
        known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        both = both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        both.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(SCHEMA).parquet(out)
