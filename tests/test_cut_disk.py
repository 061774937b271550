"""A cut plan leaves nothing of its shuffles on disk, and neither do the runs that a pattern without a bound puts together."""

import time

from pyspark.sql import functions as F

from runloom.functions.workers import cut
from runloom.operators import run_text


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def left(spark, before):
    for _ in range(50):
        if not (more := shuffled(spark) - before):
            break
        time.sleep(0.2)
    return more


def test_a_cut_leaves_no_shuffle_files(spark):
    before, rows = shuffled(spark), spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    done = cut(rows)
    assert not left(spark, before) and done.count() == 7
    assert cut(rows.where("k < 3")).count() == 3 and rows.agg(F.sum("count")).first()[0] == 1000


def test_runs_put_together_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    pieces = spark.createDataFrame([(f"t{i % 5}", i, f"x{i}") for i in range(20)], "trace_id string, place bigint, text string").repartition(2)
    out = run_text.found(pieces, {"a": "^x0 x5 x10", "b": "x1+ x6"})
    assert not left(spark, before)
    assert {(r.trace_id, r.a, r.b) for r in out.collect()} == {(f"t{i}", i == 0, i == 1) for i in range(5)}
