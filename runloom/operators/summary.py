"""Summaries of traces and diffs for a judge within a budget of tokens, and what judging them costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS, RESERVED, OVERHEAD, MOST_DIFFS = 4, 200, 320, 15
# Prices of a million tokens, read and written, by model.
RATES = {"small": (0.25, 1.25), "medium": (3.0, 15.0), "large": (15.0, 75.0)}


def cut_text(c: Column, n: int) -> Column:
    """The first n characters; the last three are dots where more stood."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def windowed(c: Column, other: Column, n: int) -> Column:
    """n characters around the first place where a text differs from another, with dots where it was cut."""
    at = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.least(F.length(c), F.length(other)) + F.lit(2.0))).cast("int")), F.struct(F.lit(0).alias("lo"), F.least(F.length(c), F.length(other)).alias("hi")),
        lambda s, _: F.when(F.substring(c, F.lit(1), F.ceil((s["lo"] + s["hi"]) / 2).cast("int")) == F.substring(other, F.lit(1), F.ceil((s["lo"] + s["hi"]) / 2).cast("int")),
                            F.struct(F.ceil((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), (F.ceil((s["lo"] + s["hi"]) / 2).cast("int") - 1).alias("hi"))),
    )["lo"]  # fmt: skip  # by halves, as many as the length asks for
    first = F.greatest(F.lit(0), F.least(at - n // 4, F.length(c) - n)).cast("int")
    part = F.substring(c, first + 1, F.lit(n))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(first > 0, "...").otherwise(""), part, F.when(first + n < F.length(c), "...").otherwise("")))


def summarize(traces: DataFrame, steps: DataFrame, budget_tokens: int = 3000) -> DataFrame:
    """(trace_id, text, tokens, shown, omitted) of effective() traces with their steps.

    The last failure comes first, then errors, outputs and decisions, then the rest; each step that still fits is taken, and they stand in
    step order. Only the lengths of a trace's lines meet in one row; the lines that fit are few, whatever the trace.
    """
    budget = budget_tokens * CHARS
    head = F.concat_ws(
        "\n", F.concat(F.lit("TRACE: "), "agent_name", F.lit(" ["), F.upper("status"), F.lit("]")), F.concat(F.lit("INPUT: "), cut_text(F.coalesce("input", F.lit("{}")), 300)),
        F.when(F.col("output").isNotNull(), F.concat(F.lit("OUTPUT: "), cut_text(F.col("output"), 300))),
        F.concat(F.lit("\nSTEPS ("), F.col("step_count").cast("string"), F.lit(" total"), F.coalesce(F.concat(F.lit(", "), F.col("effective_tokens").cast("string"), F.lit(" tokens")), F.lit("")), F.lit("):")),
    )
    foot = F.concat_ws("\n", F.when(F.col("error").isNotNull(), F.concat(F.lit("\nERROR: "), cut_text(F.col("error"), 300))), F.concat(F.lit("TAGS: "), F.col("tag")))
    heads = traces.select(F.col("id").alias("trace_id"), head.alias("head"), foot.alias("foot")).withColumn("room", F.lit(budget - RESERVED) - F.length("head"))
    failed = F.col("error").isNotNull() | (F.col("step_type") == "error")
    line = F.concat_ws(
        " ", F.concat(F.lit("#"), F.col("step_number").cast("string")), F.concat(F.lit("["), "step_type", F.lit("]")), "name",
        F.when(F.col("output").isNotNull(), F.concat(F.lit("-> "), cut_text(F.col("output"), 200))), F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR "), cut_text(F.col("error"), 200))),
    )
    rows = steps.select("trace_id", "step_number", line.alias("line"), failed.alias("failed"), (failed | F.col("step_type").isin("output", "decision")).alias("important"))
    last = rows.where("failed").groupBy("trace_id").agg(F.max("step_number").alias("last"))
    rank = F.when(F.col("step_number") == F.col("last"), 0).when(F.col("important"), 1).otherwise(2)
    sized = rows.join(last, "trace_id", "left").select("trace_id", F.struct(rank.alias("r"), F.col("step_number").alias("n"), F.length("line").alias("size")).alias("x"))
    order = sized.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(heads.select("trace_id", "room"), "trace_id")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda s, x: (s["used"] + x["size"] + 1) <= F.col("room")
    add = lambda s, x: F.struct((s["used"] + x["size"] + 1).alias("used"), F.concat(s["kept"], F.array(x["n"])).alias("kept"))
    kept = F.aggregate("xs", start, lambda s, x: F.when(fits(s, x), add(s, x)).otherwise(s))["kept"]
    chosen = order.select("trace_id", F.size("xs").alias("all"), F.explode_outer(kept).alias("step_number"))
    lines = chosen.join(rows.select("trace_id", "step_number", "line"), ["trace_id", "step_number"], "left")
    text = lines.groupBy("trace_id").agg(
        F.max("all").alias("all"), F.count("line").alias("shown"), F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("step_number", "line")))), lambda x: x["line"]).alias("lines")
    )
    out = heads.join(text, "trace_id", "left").withColumn("omitted", F.coalesce(F.col("all") - F.col("shown"), F.lit(0)))
    note = F.when(F.col("omitted") > 0, F.concat(F.lit("... ("), F.col("omitted").cast("string"), F.lit(" more steps omitted)")))
    whole = F.concat_ws("\n", "head", F.when(F.size("lines") > 0, F.array_join("lines", "\n")), note, F.nullif("foot", F.lit("")))
    out = out.select("trace_id", whole.alias("text"), F.coalesce("shown", F.lit(0)).alias("shown"), "omitted")
    return out.withColumn("tokens", F.ceil(F.length("text") / CHARS))


def summarize_diff(differences: DataFrame) -> DataFrame:
    """(pair_id, text, listed, more): the first differences of each pair in the order of steps, each side around where it parts from the other."""
    where = F.when(F.col("step_number").isNull(), "Trace").otherwise(F.concat(F.lit("Step "), F.col("step_number").cast("string")))
    side = lambda c, o: F.when(F.col(c).isNull(), "(missing)").otherwise(windowed(F.col(c), F.coalesce(F.col(o), F.lit("")), 80))
    order = F.struct(F.col("step_number").isNull().alias("t"), "step_number", "field")
    ranked = differences.withColumn("r", F.row_number().over(Window.partitionBy("pair_id").orderBy(order)))
    count = differences.groupBy("pair_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), where, F.lit(", "), "field", F.lit(": LEFT="), side("left", "right"), F.lit(" | RIGHT="), side("right", "left"))
    top = ranked.where(F.col("r") <= MOST_DIFFS).select("pair_id", F.struct("r", line.alias("line")).alias("x")).groupBy("pair_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    out = top.join(count, "pair_id").select("pair_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text"), F.size("xs").alias("listed"), (F.col("n") - F.size("xs")).alias("more"))
    return out


def cost(tokens: Column, model: str, max_tokens: int, applies: Column | None = None) -> Column:
    """US dollars of judging a summary of so many tokens; an unknown model costs as the dearest does, and a judge that does not apply nothing."""
    read, write = RATES.get(model, tuple(map(max, zip(*RATES.values()))))
    usd = ((tokens + OVERHEAD) * read + max_tokens * write) / 1_000_000
    return usd if applies is None else F.when(applies, usd).otherwise(0.0)
