"""Exports: whole traces as JSON or JSON lines, golden baselines, and reading them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsons import merged

STEP_COLUMNS = ("step_number", "step_type", "name", "input", "output", "duration_ms", "tokens_used", "model", "error", "parent_step_number", "caused_by_step_number")
RESERVED = ("status", "total_duration_ms", "total_tokens", "tags")
GOLDEN = (
    "id string, agent_name string, input string, expected_output string, steps_summary array<struct<step_number: int, step_type: string,"
    " name: string, input: string, model: string, failed: boolean>>, eval_criteria array<struct<evaluator_name: string, score: double,"
    " passed: boolean>>, metadata string"
)


def payload(c: str) -> Column:
    """A JSON text as the value that it holds; a text that is no JSON as itself."""
    x = F.col(c)
    return F.when(x.isNotNull(), F.coalesce(F.try_parse_json(x), F.to_variant_object(F.array(x))))


def _nested(children: DataFrame, fields: Column, order: str, name: str) -> DataFrame:
    return children.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, fields.alias("x")))), lambda v: v["x"]).alias(name))


def _beside(steps: DataFrame, own: dict[str, DataFrame]) -> DataFrame:
    """steps with a column for each of own (trace_id, step_number, name): a left join with each. All rows are dealt by trace once, which the grouping by
    trace that follows needs too, so that the steps are shuffled once."""
    if not own:
        return steps
    every = steps.withColumn("__step", F.lit(True))
    for records in own.values():
        every = every.unionByName(records.where("step_number is not null"), allowMissingColumns=True)
    here = Window.partitionBy("trace_id", "step_number")
    every = every.repartition("trace_id").withColumns({n: F.collect_list(n).over(here) for n in own}).where("__step").drop("__step")
    for n in own:
        every = every.select("*", F.explode_outer(n).alias("__one")).drop(n).withColumnRenamed("__one", n)
    return every


def export_rows(
    traces: DataFrame, steps: DataFrame, decisions: DataFrame | None = None, evals: DataFrame | None = None, snapshots: DataFrame | None = None
) -> DataFrame:
    """(id, json): a trace with its steps in order, and decisions, verdicts and snapshots where given. Nulls are written.

    A document is one trace, so its steps stand in one row here, as in the format itself.
    """
    own = {}
    if decisions is not None:
        own["decision"] = decisions.select("trace_id", "step_number", F.struct("options", "chosen", "rationale", "confidence", "decided_by").alias("decision"))
    if snapshots is not None:
        own["snapshot"] = snapshots.select("trace_id", "step_number", F.struct("context_window", "environment", "tool_state", "token_count").alias("snapshot"))
    rows = _beside(steps, own)
    extra = [c for c, on in (("decision", decisions), ("snapshot", snapshots)) if on is not None]
    fields = F.struct(*(c for c in (*STEP_COLUMNS, *extra) if c in rows.columns))
    out = traces.join(_nested(rows, fields, "step_number", "steps").withColumnRenamed("trace_id", "__t"), F.col("id") == F.col("__t"), "left")
    own = [c for c in traces.columns if c not in ("trace_key", "started_ms", "ended_ms")]
    parts = [*own, F.coalesce("steps", F.array().cast(out.schema["steps"].dataType)).alias("steps")]
    if evals is not None:
        verdict = F.struct("evaluator_name", "score", "passed", "details")
        listed = _nested(evals.withColumn("__o", -F.col("seq")), verdict, "__o", "evals").withColumnRenamed("trace_id", "__e")
        out = out.join(listed, F.col("id") == F.col("__e"), "left")
        parts.append(F.coalesce("evals", F.array().cast(out.schema["evals"].dataType)).alias("evals"))
    return out.select("id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def write_jsonl(exported: DataFrame, path: str) -> None:
    """One trace a line; no traces give files without lines."""
    exported.select("json").write.mode("overwrite").text(path)


def golden_metadata(traces: DataFrame) -> Column:
    """A trace's metadata as JSON under the reserved keys; its own values of such keys move to trace_metadata_<key>."""
    kind = "map<string, variant>"
    own = F.from_json("metadata", kind)
    renamed = F.transform_keys(own, lambda k, _: F.when(k.isin(*RESERVED), F.concat(F.lit("trace_metadata_"), k)).otherwise(k))
    tags = F.col("tags") if "tags" in traces.columns else F.array(F.col("tag"))
    reserved = F.struct("status", "total_duration_ms", "total_tokens", tags.alias("tags"))
    return F.to_json(merged(F.coalesce(F.to_json(renamed), F.lit("{}")), F.to_json(reserved, {"ignoreNullFields": "false"})))


def golden_rows(traces: DataFrame, steps: DataFrame, evals: DataFrame) -> DataFrame:
    """(id, agent_name, input, expected_output, steps_summary, eval_criteria, metadata): baselines of traces that are no forks."""
    tool = F.when(F.col("step_type") == "tool_call", F.coalesce("input", F.lit("{}")))
    one = F.struct("step_number", "step_type", "name", tool.alias("input"), "model", F.col("error").isNotNull().alias("failed"))
    summary = _nested(steps, one, "step_number", "steps_summary").withColumnRenamed("trace_id", "__t")
    own = evals.where(F.coalesce(F.get_json_object("details", "$.skipped"), F.lit("false")) != "true")
    criteria = _nested(own.withColumn("__o", -F.col("seq")), F.struct("evaluator_name", "score", "passed"), "__o", "eval_criteria").withColumnRenamed("trace_id", "__e")
    rows = traces.where("parent_trace_id is null").join(summary, F.col("id") == F.col("__t"), "left").join(criteria, F.col("id") == F.col("__e"), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(
        "id", "agent_name", "input", F.col("output").alias("expected_output"), empty("steps_summary"), empty("eval_criteria"), golden_metadata(traces).alias("metadata")
    )


def baseline_warnings(traces: DataFrame) -> DataFrame:
    """(entries, not_completed) of a baseline of these traces: nought or more than nought is worth a warning."""
    return traces.where("parent_trace_id is null").agg(F.count("*").alias("entries"), F.count_if(F.col("status") != "completed").alias("not_completed"))


def write_golden(golden: DataFrame, path: str) -> None:
    """One entry a line, with its place, so that the baselines keep their order."""
    golden.select(F.to_json(F.struct(*golden.columns)).alias("json")).write.mode("overwrite").text(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Baselines of JSON files that hold an entry a line, one entry or an array of them, as golden_rows() with ord; ValueError where one can't be used."""
    raw = spark.read.schema(GOLDEN).json(path, multiLine=True)
    lines = spark.read.schema(GOLDEN).json(path)
    rows = lines if lines.where("steps_summary is not null").count() >= raw.where("steps_summary is not null").count() else raw
    rows = rows.withColumn("ord", F.col("id"))
    seen = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("steps_summary").isNull()).alias("bare"), F.count_if(F.get_json_object("metadata", "$.status").isNull()).alias("unknown")
    ).first()
    if not seen["n"]:
        raise ValueError("the baseline holds no entries")
    if seen["bare"] or seen["unknown"]:
        raise ValueError(f"{seen['bare']} entries without steps_summary, {seen['unknown']} without a status in their metadata")
    return rows


def golden_tables(golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, steps) of baselines, as compare.golden_entries() and golden_steps() of a store would take them."""
    traces = golden.select("id", F.col("ord") if "ord" in golden.columns else F.col("id").alias("ord"), "agent_name", "input", F.get_json_object("metadata", "$.status").alias("status"))
    steps = golden.select(F.col("id").alias("trace_id"), F.posexplode("steps_summary").alias("at", "s")).select("trace_id", (F.col("at") + 1).alias("ord"), "s.*")
    return traces, steps


def reimported(exported: DataFrame) -> DataFrame:
    """(traces, steps, evals, forks): what an export holds, and what reading it again leaves out (verdicts and fork lineage)."""
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object("json", path)), F.lit(0))
    return exported.agg(
        F.count("*").alias("traces"), F.sum(size("$.steps")).alias("steps"), F.sum(size("$.evals")).alias("evals"),
        F.count_if(F.get_json_object("json", "$.parent_trace_id").isNotNull()).alias("forks"),
    )


def step_window(steps: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(trace_id, shown, omitted) of the steps from first to last of each trace."""
    inside = F.col("step_number") >= first
    if last is not None:
        inside &= F.col("step_number") <= last
    return steps.groupBy("trace_id").agg(F.count_if(inside).alias("shown"), F.count_if(~inside).alias("omitted"))


def counted_page(rows: DataFrame, order: list[Column], limit: int = 25) -> DataFrame:
    """A page with the number of all rows beside each of its own."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
