"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Defined results: documents without text pass the first four stages by their score (an empty text's) and take nothing in the mix; rows with
a null id are scored, keep their lines and are in no group of near-duplicates; a document goes where its text holds a benchmark item, whatever its id; rows that
repeat an id and text are treated alike in every stage, and the mix counts each; rows that repeat an id with another text are rows of their own. Ties are broken by id, and by a seeded hash in the
mix. Columns beside those of documents are left out after the first stage. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import decontamination, line_dedup, mixing, near_dedup, quality_classifier
from runloom.llm._common import materialise, release, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches REJECT."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = quality_classifier.train(docs, known, metadata=["n_chars"])
    scored = quality_classifier.score(docs, model, metadata=["n_chars"], keep=["text", "lang", "source", "n_chars"])
    return scored.where(F.col("score") >= REJECT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line that repeats an earlier one goes; n_chars follows the text."""
    out = line_dedup.deduplicate(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.deduplicate(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (times) and with how many words (taken)."""
    mixed = mixing.mix(docs, keep=["text", "lang", "n_chars"])
    return mixed.where("taken > 0").select(*COLUMNS, "size", "target", "taken", "times")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixture),
]

# The stages learn, walk and rank: no SQL expresses them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = written()
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs, before)  # what only this stage needed
    return docs
