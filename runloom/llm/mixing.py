"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Each source has a target in words; a source whose target reaches its size is taken
whole once, and the rest of the budget is fitted by a subset of its documents. Documents are counted by exact
length, every length gets its proportional number of documents, and bounded-knapsack dynamic programming over the
leftover lengths closes the remaining gap. Which documents of a length are taken is decided by a seeded hash.

The plan works on counts: one row for each (source, length), whatever the number of documents; the documents of a
length are spread over ``SLOTS`` hash slots, so that copies that fill one length are ranked in many tasks.

Defined results: a null or empty text has size 0, target share 0 and takes nothing; the null source is one source, last in
order; rows that repeat an id are separate documents of one rank each; null ids are ranked like any
other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, ready

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SLOTS = 4096
SPAN = 16384  # words over which the dynamic programming is exact


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words to take of each source: weights repeat over the sources in code point order (null last), and what exceeds
    ``most`` times a source's size is shared again by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        rest -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take: their lengths sum up to the budget, or to the nearest sum
    below it that the leftover lengths reach."""
    total = int(length @ count)
    if budget >= total:
        return count.copy()
    if budget <= 0:
        return np.zeros_like(count)
    exact = count * (budget / total)
    take = np.floor(exact).astype(np.int64)
    rest = budget - int(length @ take)
    for i in np.argsort(-(exact - take), kind="stable"):
        if 0 < length[i] <= rest and take[i] < count[i]:
            take[i] += 1
            rest -= int(length[i])
    for i in np.argsort(-length, kind="stable"):  # the gap is then below the longest length left over
        n = min(rest // int(length[i]), int(count[i] - take[i])) if length[i] > 0 else 0
        take[i] += n
        rest -= n * int(length[i])
    if rest <= 0:
        return take
    # Documents are given back, one of each length in turn, until the gap is SPAN wide; the best sum for it is found exactly.
    order = np.flatnonzero(length > 0)
    while rest < SPAN and take[order].any():
        for i in order[take[order] > 0]:
            if rest >= SPAN:
                break
            take[i] -= 1
            rest += int(length[i])
    free = count - take
    reached, by, times = np.zeros(rest + 1, bool), np.full(rest + 1, -1), np.zeros(rest + 1, np.int64)
    reached[0] = True
    for i in order[(length[order] <= rest) & (free[order] > 0)]:
        left, part = min(int(free[i]), rest // int(length[i])), 1
        while left > 0 and not reached[rest]:
            m = min(part, left)
            step = m * int(length[i])
            fresh = np.zeros(rest + 1, bool)
            fresh[step:] = reached[:-step] & ~reached[step:]
            by[fresh], times[fresh] = i, m
            reached |= fresh
            left, part = left - m, part * 2
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        take[by[at]] += times[at]
        at -= int(times[at] * length[by[at]])
    return take


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words: 0, or the size, or twice of it), times; and the columns in keep."""
    spark = ready(docs.sparkSession)
    ident = F.col(id_col)
    sized = docs.select(
        ident.alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), ident).alias("h"), *(F.col(c) for c in keep),
    ).withColumn("slot", F.pmod(F.col("h"), F.lit(SLOTS)))
    sized = materialise(sized, "sizes")
    slots = materialise(sized.groupBy("source", "size", "slot").agg(F.count("*").alias("n")), "lengths")
    lengths = slots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = {r[0]: int(r[1]) for r in lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size"))).collect()}  # a row a source
    goal = targets(by_source, weights, share, most)
    table = spark.createDataFrame(
        [(s, s is None, by_source[s], float(goal[s])) for s in by_source], "source string, no boolean, source_size bigint, target double"
    )

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rows = rows.sort_values("size", ignore_index=True)
        whole = int(target // size) if size else 0
        extra = fit_budget(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), round(target - whole * size))
        return rows.assign(whole=whole, extra=extra)[["source", "size", "source_size", "target", "whole", "extra"]]

    known = lengths.join(table, lengths.source.eqNullSafe(table.source)).select(lengths.source, "size", "n", "source_size", "target")
    planned = known.groupBy("source").applyInPandas(
        plan, "source string, size bigint, source_size bigint, target double, whole bigint, extra bigint"
    )
    planned = materialise(planned, "plan").withColumnsRenamed({"source": "s", "size": "z"})
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slots.withColumn("before", F.coalesce(before, F.lit(0)))
    offsets = offsets.join(planned, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    offsets = offsets.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("slot").alias("t"), "before", "source_size", "target", "whole", "extra"
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("h", "doc_id"))
    ranked = sized.withColumn("rank", rank)
    out = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slot") == F.col("t")))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("bigint"))
    out = out.withColumn("times", times)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", *keep)
