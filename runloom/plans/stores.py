"""Named queries over stores that are written, patched and merged into, each with its oracle in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import cut, shared
from ..operators import otlp
from ..sources.fixtures import Store
from ..sources.store import TraceStore
from . import telemetry
from .queries import ORACLES, query

DELIVERIES = 2


def fresh(s: Store, buckets: int = 8) -> TraceStore:
    return TraceStore(s.spark, f"{shared(s.spark)}/runloom-store-{uuid.uuid4().hex}", buckets)


def filled(s: Store) -> TraceStore:
    """The fixture's traces and steps as a store."""
    store = fresh(s)
    store.append("traces", s.traces)
    store.append("steps", s.steps)
    return store


def merged(s: Store) -> DataFrame:
    """Span batches delivered in two parts, dealt by a hash, with the first part again at the end."""
    store = fresh(s)
    spans = otlp.read_spans(telemetry.span_batches(s)).withColumn("part", F.pmod(F.xxhash64("trace_id", "span_id", "seq.seq"), F.lit(DELIVERIES)))
    spans = store.interim("delivered", spans)
    for part in (*range(DELIVERIES), 0):
        store.merge_spans(spans.where(F.col("part") == part).drop("part"), lying=True)
        store.vacuum(1)  # no other writer knows this store
    store.forget("delivered")
    ids = store.table("traces").select(F.col("id").alias("trace_id"), F.get_json_object("metadata", "$.otel_trace_id").alias("otel"))
    return store.table("steps").join(ids, "trace_id").drop("trace_id").withColumnRenamed("otel", "trace_id")


query("store_merged_spans", ORACLES["otlp_steps"], raw=True)(
    lambda s: merged(s).select("trace_id", "step_number", "step_type", "name", "input", "duration_ms", "tokens_used", "model", "error", "parent_step_number")
)


def patched(s: Store) -> DataFrame:
    """Every third trace is closed and every fifth gets an error that is taken back; then every trace that still runs gets a step after its last."""
    store = filled(s)
    keyed = store.table("traces").select("id", F.substring("id", 5, 20).cast("bigint").alias("k"))
    close = keyed.where("k % 3 = 0").select("id", F.lit(1).alias("seq"), F.lit('{"status": "Success", "total_tokens": 7, "ended_at": "2020-01-01T00:00:00Z"}').alias("patch"))
    spoil = keyed.where("k % 5 = 0").select("id", F.lit(2).alias("seq"), F.lit('{"error": "oh", "status": "odd"}').alias("patch"))
    store.patch("traces", close.union(spoil).union(spoil.withColumn("seq", F.lit(3)).withColumn("patch", F.lit('{"error": null}'))))
    running = store.table("traces").where("status = 'running'").select(F.col("id").alias("trace_id"))
    last = store.table("steps").groupBy("trace_id").agg(F.max("step_number").alias("n"))
    more = store.table("traces").select(F.col("id").alias("trace_id")).join(last, "trace_id", "left").selectExpr("trace_id", "cast(coalesce(n, 0) + 1 as int) as step_number", "'output' as step_type", "'added' as name")
    more = cut(more)  # counted below
    faults = store.append_steps(more)
    ran = running.count()
    if faults.count() + ran != more.count():
        raise AssertionError("every step is added or refused")
    steps = store.table("steps").groupBy(F.col("trace_id").alias("id")).agg(F.count("*").alias("steps"))
    out = store.table("traces").join(steps, "id", "left")
    return out.select("id", "status", "total_tokens", "error", F.coalesce("steps", F.lit(0).cast("bigint")).alias("steps"))


query("store_patched", """, t as (select *, cast(substr(id, 5) as bigint) as k from traces),
 n as (select *, case when k % 5 = 0 then 'failed' when k % 3 = 0 then 'completed' else status end as now from t)
 select id, now as status, case when k % 3 = 0 then 7 else total_tokens end as total_tokens, case when k % 5 <> 0 then error end as error,
 (select count(*) from steps s where s.trace_id = id) + case when now = 'running' then 1 else 0 end as steps from n""")(patched)
query("store_trace_keyed", "select step_number, name, tokens_used from steps where trace_id = 'trc_101'")(
    lambda s: filled(s).trace("steps", "trc_101").select("step_number", "name", "tokens_used")
)
