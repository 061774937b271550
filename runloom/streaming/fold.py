"""Streaming forms: capture events land in an append-only log, and every micro-batch folds the traces it touched anew.

A fold over the whole log of a trace gives the same rows whatever the batches were, so late and repeated
deliveries need no watermark. State is the log itself, as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64


def run_fold(
    spark: SparkSession, source: str, schema: str, log: str, out: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame], key: str = "trace_id"
) -> StreamingQuery:
    """Follows JSON lines that appear in ``source``. Each batch is put into the log and the folded rows of its
    keys are written to out/batch=N; the highest batch of a key holds its present row. The log is divided by a hash of the key
    into ``BUCKETS`` folders, and a batch reads those only that it touched."""

    def batch(rows: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch={n}")
        stored = spark.read.schema(f"{schema}, batch int, bucket int").parquet(log)
        mine = stored.where(f"batch = {n}")
        buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # at most BUCKETS
        touched = mine.select(key).distinct()
        whole = stored.where(F.col("bucket").isin(buckets) & (F.col("batch") <= n)).drop("batch", "bucket")
        fold(whole.join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str = "trace_id") -> DataFrame:
    """The present row of each key."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(key).agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(last, [key, "batch"]).drop("batch")
