"""What the operators share: a folder that all executors see, cut lineage, and components."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/runloom-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def ready(spark: SparkSession) -> SparkSession:
    """Lets the workers of a session on this machine import the package (a cluster gets it by --py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def release(kept: DataFrame, since: int) -> int:
    """Removes what was written after the first ``since`` paths, but for the files of kept, which nothing else may read by now; the new number of paths."""
    own = kept.inputFiles()
    for spark, path in _written[since:]:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in own):
            _remove(spark, path)
    _written[since:] = [x for x in _written[since:] if any(f"/{x[1].rsplit('/', 1)[-1]}/" in f for f in own)]
    return len(_written)


def written() -> int:
    """How many paths were written and are still there."""
    return len(_written)


atexit.register(_drop_written)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/runloom-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b), both long: rows (node, comp), comp the smallest node reachable.

    Distributed union-find: each round hooks every node's neighbours to its smallest neighbour
    (large-star), then every node's smaller neighbours to the smallest of them (small-star),
    until the edges stop changing. Only groupBy-min and equi-joins are used, so a hub is
    pre-aggregated and its join side can be split; the number of rounds grows with the logarithm of the diameter.
    """
    e = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def digest(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    last = digest(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:  # every round that changes an edge brings nodes nearer to their smallest one, so it ends
        # large-star: every larger neighbour of u goes to the smallest node in u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small-star: u's smaller neighbours, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.where("u <> v").distinct(), "edges")
        now = digest(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        last = now
