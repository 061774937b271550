"""Decisions, snapshots and verdicts beside traces and steps, at (trace_id, step_number) or trace_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["trace_id", "step_number"]


def with_decisions(steps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every step, with what was decided on it, if anything."""
    return steps.join(decisions.select(*KEY, "options", "chosen", "rationale", "confidence", "decided_by"), KEY, "left")


def decision_points(steps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Steps of type decision, and those of any type that hold a record of one."""
    rows = with_decisions(steps, decisions)
    return rows.where((F.col("step_type") == "decision") | F.col("chosen").isNotNull())


def with_snapshots(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The steps that hold a snapshot, with it."""
    return steps.join(snapshots.select(*KEY, "context_window", "environment", "tool_state", "token_count"), KEY)


def attached(records: DataFrame, seq: str = "seq") -> DataFrame:
    """The record of the highest seq at each step: a later attachment replaces an earlier one."""
    w = Window.partitionBy(*KEY).orderBy(F.col(seq).desc())
    return records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def measured(details: Column) -> Column:
    """Whether a verdict was reached; a skipped evaluator stores one without."""
    return F.coalesce(F.get_json_object(details, "$.skipped"), F.lit("false")) != "true"


def skipped_eval(traces: DataFrame, name: str, reason: str) -> DataFrame:
    """Verdicts that say that an evaluator did not apply: score 1, passed, details.skipped."""
    details = F.to_json(F.struct(F.lit(True).alias("skipped"), F.lit(reason).alias("reason")))
    return traces.select(F.col("id").alias("trace_id"), F.lit(name).alias("evaluator_name"), F.lit(1.0).alias("score"), F.lit(True).alias("passed"), details.alias("details"))


def newest_evals(evals: DataFrame, trace_ids: DataFrame | None = None) -> DataFrame:
    """Verdicts with their rank in their trace, newest first; those of one moment by the order of writing."""
    rows = evals if trace_ids is None else evals.join(trace_ids.select(F.col("id").alias("trace_id")), "trace_id", "left_semi")
    w = Window.partitionBy("trace_id").orderBy(F.col("evaluated_ms").desc_nulls_last(), F.col("seq").desc())
    return rows.withColumn("rank", F.row_number().over(w))


def recent_scores(evals: DataFrame, n: int = 20) -> DataFrame:
    """(place, trace_id, score, passed) of the n newest verdicts that were reached, oldest first."""
    newest = evals.where(measured(F.col("details"))).orderBy(F.col("evaluated_ms").desc_nulls_last(), F.col("seq").desc()).limit(n)
    w = Window.orderBy(F.col("evaluated_ms").asc_nulls_first(), "seq")  # over n rows
    return newest.select(F.row_number().over(w).alias("place"), "trace_id", "score", "passed")


def eval_totals(evals: DataFrame) -> DataFrame:
    """(evaluator_name, passed, failed, skipped, avg_score): the average is of the verdicts that were reached."""
    own = measured(F.col("details"))
    return evals.groupBy("evaluator_name").agg(
        F.count_if(own & F.col("passed")).alias("passed"), F.count_if(own & ~F.col("passed")).alias("failed"), F.count_if(~own).alias("skipped"),
        F.round(F.avg(F.when(own, F.col("score"))), 6).alias("avg_score"),
    )


def children_of(traces: DataFrame, children: DataFrame) -> DataFrame:
    """The rows of children that belong to these traces."""
    return children.join(traces.select(F.col("id").alias("trace_id")), "trace_id", "left_semi")


def next_step_number(steps: DataFrame) -> DataFrame:
    """(trace_id, next_number): one after the highest."""
    return steps.groupBy("trace_id").agg((F.max("step_number") + 1).cast("int").alias("next_number"))


def by_metadata(traces: DataFrame, key: str, value: str | None) -> DataFrame:
    """Traces whose metadata hold this scalar at the key; None finds those without one."""
    return traces.where(F.get_json_object("metadata", f"$.{key}").eqNullSafe(F.lit(value).cast("string")))


def delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without these traces (id): their rows go everywhere, and forks of them lose their parent."""
    ids = gone.select(F.col("id").alias("__gone"))
    out = {}
    for name, df in tables.items():
        key = "id" if name == "traces" else "trace_id"
        out[name] = df.join(ids, F.col(key) == F.col("__gone"), "left_anti")
    parents = ids.withColumnRenamed("__gone", "__parent").withColumn("__lost", F.lit(True))
    t = out["traces"].join(parents, F.col("parent_trace_id") == F.col("__parent"), "left")
    out["traces"] = t.withColumn("parent_trace_id", F.when(F.col("__lost").isNull(), F.col("parent_trace_id"))).drop("__parent", "__lost")
    return out
