"""Where tasks find this package, and where plans are cut."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready() -> SparkSession:
    """The running session, whose workers on this machine can import the package (a cluster gets it by --py-files)."""
    spark = SparkSession.active()
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/runloom-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when it is done, instead of when the driver's garbage is collected: they are as large as what it read, and a job of many queries
    would hold those of all."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage and plan cut."""
    shared(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, so that df can still be used
