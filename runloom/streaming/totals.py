"""Standing totals over the traces that are appended to a store, kept by a streaming aggregation instead of a query over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.browse import STATUSES

GROUPS = "agent_name string, status string, traces bigint, steps bigint, duration_ms bigint, measured bigint, tokens bigint, cost_usd double"


def grouped(traces: DataFrame) -> DataFrame:
    """Sums by agent and status of a stream of effective() traces, forks left out. The state is a row for each agent and status."""
    return traces.where("parent_trace_id is null").groupBy("agent_name", "status").agg(
        F.count("*").alias("traces"), F.sum("step_count").cast("bigint").alias("steps"), F.sum("duration_ms").cast("bigint").alias("duration_ms"),
        F.count("duration_ms").alias("measured"), F.sum("effective_tokens").cast("bigint").alias("tokens"), F.sum("total_cost_usd").alias("cost_usd"),
    )


def keep(traces: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Follows the traces. Each batch writes the groups that it changed to out/batch=N, over what an earlier attempt of it wrote."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = grouped(traces).writeStream.outputMode("update").foreachBatch(batch)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def groups(spark: SparkSession, out: str) -> DataFrame:
    """The groups as they stand: the last batch that changed one has it."""
    rows = spark.read.schema(f"{GROUPS}, batch int").parquet(out)
    fields = [f.split()[0] for f in GROUPS.split(", ")]
    last = rows.groupBy("agent_name", "status").agg(F.max_by(F.struct(*fields[2:]), "batch").alias("x"))
    return last.select("agent_name", "status", "x.*")


def store_totals(standing: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return standing.agg(
        whole("traces"), F.sum("steps").alias("steps"), F.round(F.sum("duration_ms") / F.sum("measured")).cast("bigint").alias("avg_duration_ms"), whole("measured"),
        F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 2).alias("cost_usd"),
    )


def status_counts(standing: DataFrame) -> DataFrame:
    """(ord, status, n) of every status, those without traces too."""
    names = standing.sparkSession.createDataFrame(list(enumerate(STATUSES)), "ord int, status string")
    found = standing.groupBy("status").agg(F.sum("traces").alias("n"))
    return names.join(found, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def agent_counts(standing: DataFrame) -> DataFrame:
    failed = F.sum(F.when(F.col("status").isin("failed", "timeout"), F.col("traces")).otherwise(0)).alias("failed")
    return standing.groupBy("agent_name").agg(F.sum("traces").alias("n"), failed)
