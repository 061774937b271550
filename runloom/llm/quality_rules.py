"""Quality rules by weak supervision: rules vote, and expectation-maximisation weighs the votes.

Every rule looks at one statistic of the whole text and votes *good*, *bad* or abstains.
Rows are pre-aggregated to counts of vote patterns, of which there are at most 3**len(RULES)
whatever the input, so the estimation runs on that bounded table on the driver: a two-class
latent model with one table P(vote | class) per rule, Laplace-smoothed. A text is kept where
the posterior probability of the good class is at least one half; no rule is decisive alone.

Defined results: a null text has no words, an empty text likewise; both fail the base rules.
A null doc_id is carried through; repeated rows are judged alike and each returned; columns
other than the named two are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, ready
from ._stats import FIELDS, ratios, text_stats
from ._text import blocks

#: (name, statistic, good from, good to, bad below, bad above); elsewhere the rule abstains. A rule that
#: looks for a fault has no good range: the absence of one fault says nothing of the others.
#: Statistics: a column of ratios(), or -1 for the number of words.
RULES = (
    ("length", -1, 80, 1e12, 50, 1e12),
    ("symbols", 0, 1, 0, -1, 0.15),
    ("repeats", 1, 1, 0, -1, 0.4),
    ("copied_lines", 2, 1, 0, -1, 0.4),
    ("capitals", 3, 1, 0, -1, 0.35),
    ("exclamations", 4, 1, 0, -1, 0.2),
    ("word_length", 5, 3, 8, 2, 14),
    ("variety", 6, 0.7, 1e12, 0.35, 1e12),
    ("short_words", 7, 0.15, 0.7, 0.05, 0.97),
)
#: Prior belief: the share of good texts, and the share of them on which a rule votes bad, both held as firmly as
#: FIRM times the observed rows would. Without it faults that each show in one rule only don't tell which class is which, and the
#: classes collapse into one. All else about the rules, good votes and abstentions included, follows the data.
GOOD_SHARE, FALSE_ALARM, FIRM = 0.8, 0.0005, 10.0
GOOD, BAD = 1, 2


def votes(counts: np.ndarray) -> np.ndarray:
    """Vote patterns of texts as base-3 numbers, rule i being digit i: 0 abstains, 1 good, 2 bad."""
    r, code = ratios(counts), np.zeros(len(counts), np.int64)
    for i, (_, column, lo, hi, below, above) in enumerate(RULES):
        x = counts[:, 0] if column < 0 else r[:, column]
        vote = np.where((x < below) | (x > above), BAD, np.where((x >= lo) & (x <= hi), GOOD, 0))
        code += vote * 3**i
    return np.where(counts[:, 0] == 0, 0, code)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of the good class for each pattern, by expectation-maximisation."""
    if not len(patterns):
        return np.zeros(0)
    digits = np.stack([patterns // 3**i % 3 for i in range(len(RULES))], axis=1)
    n = counts.astype(np.float64)
    bad, good = (digits == BAD).sum(1), (digits == GOOD).sum(1)
    post, held = np.where(bad > 0, 0.2**bad, np.where(good > 0, 0.95, 0.8)), FIRM * n.sum()
    for _ in range(rounds):
        prior = (n @ post + held * GOOD_SHARE) / (n.sum() + held)
        logit = np.full(len(patterns), np.log(prior) - np.log1p(-prior))
        for i in range(len(RULES)):
            table = np.ones((2, 3))
            for v in range(3):
                at = digits[:, i] == v
                table[0, v] += n[at] @ (1 - post[at])
                table[1, v] += n[at] @ post[at]
            alarm = (table[1, BAD] - 1 + held * FALSE_ALARM) / (table[1].sum() - 3 + held)
            share = table[1] / table[1, :BAD].sum() * (1 - alarm)
            share[BAD] = alarm
            ratio = np.log(share) - np.log(table[0] / table[0].sum())
            ratio[BAD] = min(ratio[BAD], 0.0)  # a bad vote never speaks for a text, nor a good one against it
            ratio[GOOD] = max(ratio[GOOD], 0.0)
            logit += ratio[digits[:, i]]
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of FIELDS and the vote pattern of each row."""
    schema = f"{id_col} bigint, " + ", ".join(f"{x} bigint" for x in FIELDS) + ", pattern bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                counts = text_stats(texts[a:b])[0]
                cols = [batch.column(0).slice(a, b - a), *(pa.array(counts[:, j]) for j in range(len(FIELDS)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(votes(counts))], [id_col, *FIELDS, "pattern"])

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() with ``quality`` (posterior of the good class), base_failed and kept."""
    spark = ready(docs.sparkSession)
    rows = materialise(measure(docs, id_col, text_col), "rules")
    seen = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3**len(RULES) rows
    patterns = np.array([r[0] for r in seen], np.int64)
    post = fit(patterns, np.array([r[1] for r in seen], np.int64))
    table = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, post)], "pattern bigint, quality double"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.join(F.broadcast(table), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= 0.5))
    )
