"""Named queries that replay tables as streams; the oracles are those of the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import shared
from ..operators import otlp, validate
from ..sources.fixtures import Store
from ..streaming import stateful, totals
from . import ingests, telemetry
from .queries import ORACLES, eff, query

BATCHES, FILES = 4, 4


def replayed(spark: SparkSession, rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A stream of rows in BATCHES micro-batches, dealt by a hash of key in no order of it, with the second of arrival as arrived, and a folder for its output."""
    root = f"{shared(spark)}/runloom-stream-{uuid.uuid4().hex}"
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(BATCHES)))
    dealt.write.partitionBy("batch").parquet(f"{root}/dealt")  # rows are worked out once
    dealt = spark.read.schema(dealt.schema).parquet(f"{root}/dealt")
    for b in range(BATCHES):
        mine = dealt.where(F.col("batch") == b).withColumn("arrived", F.timestamp_seconds(F.col("batch") + 1)).drop("batch")
        mine.repartition(FILES).write.mode("append").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/in"), root


def folded(s: Store, kind: str, schema: str) -> DataFrame:
    """Capture lines folded as a stream. A last batch, an hour later, lets every trace that is not ended fall silent."""
    lines, root = replayed(s.spark, ingests.capture_lines(s), "seq")
    late = s.spark.createDataFrame([(-1, '{"type": "trace_start", "agent_name": "clock", "trace_id": "!clock"}', 3600)], "seq bigint, line string, t bigint")
    late.select("seq", "line", F.timestamp_seconds("t").alias("arrived")).write.mode("append").parquet(f"{root}/in")
    changes = stateful.fold_stream(stateful.patches(validate.read_events(lines)), 600_000, clock="arrival")
    stateful.start(changes, f"{root}/out", f"{root}/state").awaitTermination()
    return stateful.current(s.spark, f"{root}/out", kind, schema).where("trace_id <> '!clock'")


query("stream_fold_steps", ORACLES["event_fold_steps"], raw=True)(
    lambda s: folded(s, "step", stateful.STEP).select("trace_id", "step_number", "name", "output", "tokens_used", "parent_step_number")
)
query("stream_fold_decisions", ORACLES["event_fold_decisions"], raw=True)(
    lambda s: folded(s, "decision", stateful.DECISION).select("trace_id", "step_number", "chosen")
)
query("stream_fold_traces", ORACLES["event_fold_traces"], raw=True)(lambda s: folded(s, "trace", stateful.TRACE).select("trace_id", "agent_name", "status"))


def streamed_spans(s: Store) -> DataFrame:
    """Span batches read as a stream, in no order of their traces."""
    batches, root = replayed(s.spark, telemetry.span_batches(s), "body")
    stateful.start(stateful.span_stream(otlp.read_spans(batches)), f"{root}/out", f"{root}/state").awaitTermination()
    return stateful.current(s.spark, f"{root}/out", "step", stateful.SPAN_STEP)


query("stream_otlp_steps", ORACLES["otlp_steps"], raw=True)(
    lambda s: streamed_spans(s).select("trace_id", "step_number", "step_type", "name", "input", "duration_ms", "tokens_used", "model", "error", "parent_step_number")
)


def standing(s: Store) -> DataFrame:
    """Groups of the traces, appended in batches."""
    fields = ("id", "agent_name", "status", "parent_trace_id", "step_count", "duration_ms", "effective_tokens", "total_cost_usd")
    traces, root = replayed(s.spark, eff(s).select(*fields), "id")
    totals.keep(traces, f"{root}/out", f"{root}/state").awaitTermination()
    return totals.groups(s.spark, f"{root}/out")


query("stream_store_totals", ORACLES["store_totals"], raw=True)(lambda s: totals.store_totals(standing(s)))
query("stream_status_counts", ORACLES["status_counts"], raw=True)(lambda s: totals.status_counts(standing(s)))
query("stream_agent_counts", ORACLES["agent_counts"], raw=True)(lambda s: totals.agent_counts(standing(s)))
