"""Running sums and maxima of long keys, in blocks, so that no key is sorted in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def running(rows: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column] | None = None, tops: Mapping[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """rows with sums over the rows of their key up to and with theirs, and tops, the maxima over those before theirs (null: none).

    order is a whole number, different in each row of a key; keys are not null. A window holds the rows of one block of `block` values of order, a second one
    the totals of a key's blocks, which are joined back. rows is read twice, so that it should be a cut or cheap plan.
    """
    sums, tops = sums or {}, tops or {}
    values = {f"_{n}": c for n, c in (*sums.items(), *tops.items())}
    rows = rows.withColumns({"_block": F.floor(F.col(order) / block), **values})
    by = [*keys, "_block"]
    here = Window.partitionBy(*by).orderBy(order)
    totals = rows.groupBy(*by).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums), *(F.max(f"_{n}").alias(f"_{n}") for n in tops))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, *(F.sum(f"_{n}").over(earlier).alias(f"_in_{n}") for n in sums), *(F.max(f"_{n}").over(earlier).alias(f"_in_{n}") for n in tops))
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({**{f"_at_{n}": F.sum(f"_{n}").over(upto) for n in sums}, **{f"_at_{n}": F.max(f"_{n}").over(before) for n in tops}})
    zero = F.lit(0)
    out = {n: F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_at_{n}", zero) for n in sums} | {n: F.greatest(f"_in_{n}", f"_at_{n}") for n in tops}
    spare = ["_block", *values, *(f"_{k}_{n}" for n in (*sums, *tops) for k in ("in", "at"))]
    return rows.join(carried, by).withColumns(out).drop(*spare)
