"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct folded words, hashed to 2**BITS places and weighted by
log(1 + count), unit length together; one-hot bins of its structure statistics; and one-hot
bins of numeric metadata columns, where the caller names some. The pairwise term of the score,
sum over i<j of <v_i, v_j> x_i x_j, is computed in linear time as half of
sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2).

The model is fitted on the driver by AdaGrad on a bounded sample of the labelled rows: at most
``per_class`` (default 3,000) of each class, those of the smallest seeded hash. The intercept is
then corrected from the sample's class shares to those of all labelled rows, so that a score is
a probability under the labels' own shares. The model (2**16 x 9 numbers, 2.4 MB) is broadcast.

Defined results: null and empty texts are scored from their metadata and bins alone; with no
usable labels, or of one class only, every score is the share of label 1 (0.5 without labels).
Null ids are never held out of scoring and never used for fitting; repeated rows score alike;
ties of the sampling hash go by id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready
from ._stats import ratios, text_stats
from ._text import blocks

BITS, FACTORS = 16, 8
WORDS = 1 << BITS
# Bin edges of the columns of _stats.ratios().
EDGES = (
    (0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0),
    (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.8),
    (0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.5, 1.0),
    (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0),
    (0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.2, 1.6),
    (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8),
)
_BINS = 10
_META = 40
META_AT = WORDS + (len(EDGES) + 1) * _BINS


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def features(texts: list[bytes | None], meta: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature indices, values) of each text. meta: an array of numbers, NaN for null, for each metadata column."""
    counts, folded, bounds = text_stats(texts)
    r = ratios(counts)
    dense = np.empty((len(texts), len(EDGES) + 1 + len(meta)), np.int64)
    for j, edges in enumerate(EDGES):
        dense[:, j] = WORDS + j * _BINS + np.digitize(r[:, j], edges)
    dense[:, len(EDGES)] = WORDS + len(EDGES) * _BINS + np.minimum(np.log2(counts[:, 0] + 1) / 2, 9).astype(np.int64)
    for j, x in enumerate(meta):
        level = np.where(np.isnan(x), 0, 1 + np.clip(np.log2(np.maximum(np.nan_to_num(x), 0) + 1), 0, _META - 2))
        dense[:, len(EDGES) + 1 + j] = META_AT + j * _META + level.astype(np.int64)
    place = (folded >> np.uint64(64 - BITS)).astype(np.int64)
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        idx, n = np.unique(place[a:b], return_counts=True)
        x = np.log1p(n)
        if len(x):
            x /= np.sqrt(x @ x)
        out.append((np.concatenate([idx, dense[i]]), np.concatenate([x, np.ones(dense.shape[1])]).astype(np.float32)))
    return out


def raw_score(m: Model, idx: np.ndarray, x: np.ndarray) -> float:
    vx = m.v[idx] * x[:, None]
    s = vx.sum(0)
    return float(m.w0 + m.w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, share: float, epochs: int = 6) -> Model:
    """AdaGrad on the logistic loss. share: of label 1 among all labelled rows, to which the intercept is corrected."""
    rng = np.random.default_rng(7)
    m = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    gw, gv, g0, rate, l2 = np.full(size, 1e-4), np.full((size, FACTORS), 1e-3), 1e-4, 0.05, 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            idx = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            n = np.array([len(rows[i][0]) for i in batch])
            start, row = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(batch)), n)
            vx = m.v[idx] * x[:, None]
            s, q = np.add.reduceat(vx, start), np.add.reduceat(vx * vx, start)
            z = m.w0 + np.add.reduceat(m.w[idx] * x, start) + 0.5 * (s * s - q).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            used, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, err[row] * x, len(used)) + l2 * m.w[used]
            each = (err[row] * x)[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(FACTORS)], 1) + l2 * m.v[used]
            g0 += err.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            m.w0 -= rate * err.sum() / np.sqrt(g0)
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
    mine = y.mean()
    m.w0 += float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))
    return m


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "label", id_col: str = "doc_id", text_col: str = "text",
    metadata: Sequence[str] = (), per_class: int = 3000,
) -> Model:
    """Fits on at most per_class rows of each class of labels (id, label 0 or 1; others are left out)."""
    spark = ready(docs.sparkSession)
    rows = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where("id is not null and y in (0, 1)").distinct()
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    size = META_AT + _META * len(metadata)
    share = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        share = min(max(share, 1e-6), 1 - 1e-6) if n else 0.5
        return Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    key = F.xxhash64("id", F.lit(11))
    picked = [rows.where(f"y = {y}").orderBy(key, "id").limit(per_class).collect() for y in (0, 1)]
    few = spark.createDataFrame([(r[0], r[1]) for p in picked for r in p], "id bigint, y int")  # 2 * per_class rows
    sample = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"),
        *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)),
    ).join(F.broadcast(few), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                part = batch.slice(a, b - a)
                meta = [part.column(f"m{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(metadata))]
                f = features(texts[a:b], meta)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("y"),
                        pa.array([x.astype(np.int32).tobytes() for x, _ in f], pa.binary()),
                        pa.array([x.tobytes() for _, x in f], pa.binary()),
                    ],
                    ["id", "y", "idx", "x"],
                )

    got = sample.mapInArrow(run, "id bigint, y int, idx binary, x binary").dropDuplicates(["id", "y"]).collect()
    got.sort(key=lambda r: (r["id"], r["y"]))
    if len({r["y"] for r in got}) < 2:
        return Model(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    data = [(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32)) for r in got]
    return fit(data, np.array([r["y"] for r in got], float), size, share)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, score) of each row, with the columns in keep."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("binary").alias("__text"),
        *(F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(metadata)), *keep,
    )
    fields = [f for f in rows.schema.fields if not f.name.startswith("__")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in blocks(texts):
                part = batch.slice(a, b - a)
                meta = [part.column(f"__m{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(metadata))]
                z = np.array([raw_score(m, idx, x) for idx, x in features(texts[a:b], meta)])
                out = [part.column(f.name) for f in fields] + [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))]
                yield pa.RecordBatch.from_arrays(out, [*(f.name for f in fields), "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id's decimal text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
