"""The operators over the tables of a data folder: opN_<name>(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archives, decontamination, fill_in_middle, hard_negatives, html_text, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, simhash_dedup,
    url_filters,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~quality_classifier.held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    model = quality_classifier.train(docs, known, metadata=["n_chars"])
    scored = quality_classifier.score(docs, model, metadata=["n_chars"])
    return scored.select(
        "doc_id",
        quality_classifier.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("posterior")
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as labelled where labels has its id: block for low quality or toxic, else allow."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when(F.col("quality").isNotNull(), "allow")
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("label")).join(pages.select("page_id", "url"), "page_id")
    return url_filters.judge(pages, known.select("url", "label")).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate(docs, counts=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 are moved on by one, as the contract says."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.cluster(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_minhash_near_dedup, op3_license_scan, op4_mixing, op5_decontamination,
        op6_quality_rules, op7_html_text, op8_url_filters, op9_line_dedup, op10_warc,
        op11_hard_negatives, op12_simhash_near_dedup, op13_fill_in_middle,
    )
}

# No SQL for the others: their methods learn, walk, rank, hash or parse. tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positive AS (
            SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
            n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5
    """,
    "op13_fill_in_middle": """
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
        ), numbers AS (
            SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c,
                ('0x' || h[25:32])::BIGINT % 100 AS d
            FROM cut
        ), formed AS (
            SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        ), parts AS (
            SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM formed
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
}
