"""Ingest: validation, session files, call pairing, spans and event folds, set-wise over all inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabularies of the trace model, and spellings of a final status.
STEP_TYPES = ("thought", "tool_call", "llm_call", "retrieval", "output", "decision", "guard_check", "error")
STATUS_SYNONYMS = {
    "completed": "completed", "complete": "completed", "success": "completed", "succeeded": "completed", "ok": "completed",
    "done": "completed", "finished": "completed", "passed": "completed",
    "failed": "failed", "failure": "failed", "fail": "failed", "error": "failed", "errored": "failed", "crashed": "failed",
    "aborted": "failed", "cancelled": "failed", "canceled": "failed", "interrupted": "failed",
    "timeout": "timeout", "timed_out": "timeout", "timedout": "timeout", "running": "running",
}


def status_of(x: Column) -> tuple[Column, Column]:
    """(status, repaired): what can't be read counts as failed."""
    pairs = [F.lit(v) for kv in STATUS_SYNONYMS.items() for v in kv]
    known = F.try_element_at(F.create_map(*pairs), F.lower(F.trim(x)))
    return F.coalesce(known, F.lit("failed")), known.isNull()


def validate_steps(steps: DataFrame) -> DataFrame:
    """(trace_id, step_number, field, message) of every fault."""
    n = F.count("*").over(Window.partitionBy("trace_id", "step_number"))
    fault = lambda bad, field, text: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(text).alias("message")))
    refs = [
        fault(F.col(c).isNotNull() & ((F.col(c) < 1) | (F.col(c) >= F.col("step_number"))), c, "must point to an earlier step")
        for c in ("parent_step_number", "caused_by_step_number")
    ]
    faults = F.array(
        fault(F.col("step_number").isNull() | (F.col("step_number") < 1), "step_number", "must be 1 or more"),
        fault(F.col("__n") > 1, "step_number", "is not unique"),
        fault(~F.coalesce(F.col("step_type").isin(*STEP_TYPES), F.lit(False)), "step_type", "is unknown"),
        fault(F.coalesce(F.trim("name"), F.lit("")) == "", "name", "is empty"),
        fault(F.col("tokens_used") < 0, "tokens_used", "must not be negative"),
        *refs,
    )
    rows = steps.withColumn("__n", n).select("trace_id", "step_number", F.explode(F.array_compact(faults)).alias("x"))
    return rows.select("trace_id", "step_number", "x.field", "x.message")


# How turns begin that a harness writes, not a user.
ENVELOPES = ("<", "# AGENTS.md instructions", "A session-scoped Stop hook is now active", "[SYSTEM NOTIFICATION")


def is_envelope(text: Column) -> Column:
    out = F.lit(False)
    for x in ENVELOPES:
        out |= F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith(x)
    return out


def prompts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, prompt, preamble, follow_ups, answer, steps) of sessions of turns (key, turn, role, text).

    The first user turn that is no envelope is the prompt, or the first if all are; earlier ones are its preamble, later ones follow-ups
    without direct repeats; blank turns don't count. Assistant turns are steps and the last of them is the answer.
    """
    w = Window.partitionBy(key).orderBy("turn")
    said = turns.where((F.col("role") == "user") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    said = said.withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("text").over(w))
    first = F.min(F.when(~is_envelope(F.col("text")), F.col("k"))).over(Window.partitionBy(key))
    said = said.withColumn("first", F.coalesce(first, F.lit(1)))
    listed = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("k", "text")))), lambda x: x["text"])
    user = said.groupBy(key).agg(
        F.max(F.when(F.col("k") == F.col("first"), F.col("text"))).alias("prompt"), listed(F.col("k") < F.col("first")).alias("preamble"),
        listed((F.col("k") > F.col("first")) & ~F.col("before").eqNullSafe(F.col("text"))).alias("follow_ups"),
    )
    other = turns.groupBy(key).agg(
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"), F.count_if(F.col("role") == "assistant").alias("steps")
    )
    none = F.array().cast("array<string>")
    return other.join(user, key, "left").select(
        key, "prompt", F.coalesce("preamble", none).alias("preamble"), F.coalesce("follow_ups", none).alias("follow_ups"), "answer", "steps"
    )


def pair_fifo(events: DataFrame, key: str, opens: str, closes: str) -> DataFrame:
    """(key, open_id, close_id): a close ends the oldest call of its key that is still open; one that meets none is passed over.

    A close meets none where closes outnumber opens more than ever before, so the closes that count follow from running sums, and the
    nth of them ends the nth open.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(key).orderBy("ts", "event_id")
    up = F.col("event_type") == opens
    rows = events.where(F.col("event_type").isin(opens, closes)).withColumn("excess", F.sum(F.when(up, -1).otherwise(1)).over(w))
    rows = rows.withColumn("void", F.greatest(F.lit(0), F.max("excess").over(w)))
    rows = rows.withColumn("counts", up | (F.col("void") == F.coalesce(F.lag("void").over(own), F.lit(0)))).where("counts")
    each = Window.partitionBy(key, "event_type").orderBy("ts", "event_id")
    rows = rows.withColumn("nth", F.row_number().over(each))
    ids = rows.groupBy(key, "nth").agg(F.max(F.when(up, F.col("event_id"))).alias("open_id"), F.max(F.when(~up, F.col("event_id"))).alias("close_id"))
    return ids.select(key, "open_id", "close_id")


def assemble_spans(spans: DataFrame) -> DataFrame:
    """Traces of spans (trace_id, span_id, parent_id, start_ms, end_ms, tokens, failed, seq).

    A span delivered again counts once, the earliest delivery; the root's own tokens count; the status is the
    root's, or any span's where no root came. Every order and repetition of deliveries gives the same trace.
    """
    w = Window.partitionBy("trace_id", "span_id").orderBy("seq")
    spans = spans if "cost_usd" in spans.columns else spans.withColumn("cost_usd", F.lit(None).cast("double"))
    own = spans.withColumn("r", F.row_number().over(w)).where("r = 1")
    root = F.col("parent_id").isNull()
    start = F.coalesce("start_ms", F.lit(2**63 - 1))  # a span without a start comes last
    first = F.min_by(F.when(root, F.col("failed")), F.when(root, F.struct(start, "seq")))
    out = own.groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.count_if(root).alias("roots"), first.alias("root_failed"), F.max("failed").alias("any_failed"),
    )
    failed = F.when(F.col("roots") > 0, F.col("root_failed")).otherwise(F.col("any_failed"))
    return out.select(
        "trace_id", (F.col("spans") - F.when(F.col("roots") > 0, 1).otherwise(0)).cast("bigint").alias("steps"),
        F.nullif("tokens", F.lit(0)).alias("tokens"), F.nullif("cost_usd", F.lit(0.0)).alias("cost_usd"), "start_ms",
        F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        (F.col("roots") == 0).alias("synthetic"), F.when(failed, "failed").otherwise("completed").alias("status"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Traces folded from capture events (trace_id, seq, type, step_number, output, has_output, status): the last
    writer wins, an explicit null overwrites and an absent value doesn't; steps after the end are refused, late ends of steps are not."""
    w = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("type") == "trace_end").over(w), F.lit(False))
    rows = events.withColumn("late", ended & F.col("type").isin("step", "step_start")).where("not late")
    opened = F.max(F.col("type").isin("step", "step_start")).over(Window.partitionBy("trace_id", "step_number"))
    rows = rows.withColumn("known", F.col("step_number").isNotNull() & opened)
    step = F.when(F.col("known") & F.col("has_output"), F.col("seq"))
    steps = rows.where("known").groupBy("trace_id", "step_number").agg(F.max_by("output", step).alias("output"))
    done = steps.groupBy("trace_id").agg(F.count("*").alias("steps"), F.count("output").alias("outputs"))
    end = F.when(F.col("type") == "trace_end", F.col("seq"))
    traces = rows.groupBy("trace_id").agg(F.max_by("status", end).alias("status"), F.max(F.col("type") == "trace_end").alias("ended"))
    status = F.when(F.col("ended"), status_of(F.col("status"))[0]).otherwise("timeout")
    zero = F.lit(0).cast("bigint")
    return traces.join(done, "trace_id", "left").select(
        "trace_id", status.alias("status"), F.coalesce("steps", zero).alias("steps"), F.coalesce("outputs", zero).alias("outputs")
    )
