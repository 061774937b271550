"""The corpus pipeline over a small folder: every stage against brute force on its own input, and the run as a whole."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from runloom.llm import decontamination, mixing, quality_rules
from tests.llm.test_operators import one_edit_within, shingles, words_of

VOCABULARY = [f"{a}{b}" for a in "ka lo mi nu pe ro su ta vi zo".split() for b in "ban den fil gor hum jak lem nop ras tuv".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, drop string, key string"


def corpus():
    rnd = random.Random(11)
    text = lambda k: " ".join(rnd.choices(VOCABULARY, k=k))
    rows = [[i, "\n".join(text(rnd.randint(8, 30)) for _ in range(rnd.randint(2, 5)))] for i in range(90)]
    for i in range(60, 90):  # junk
        rows[i][1] = " ".join(rnd.choices(["$$$", "WIN!!", "###", "a%%%"], k=40))
    for i in range(30, 40):  # near copies
        w = rows[i - 30][1].split(" ")
        w[len(w) // 2] = "changed"
        rows[i][1] = " ".join(w)
    rows[41][1] = rows[2][1]
    rows[42][1] = rows[5][1].split("\n")[0] + "\n" + text(40)  # a line that stands earlier
    items = [(7, text(30)), (8, text(20)), (9, None)]
    rows[43][1] += "\n" + items[0][1]
    rows += [[None, items[0][1]], [45, items[0][1] + " more"]]
    rows[44][1] = text(12) + " " + " ".join([*items[1][1].split()[:9], "other", *items[1][1].split()[10:]]) + " " + text(9)
    rows += [[90, None], [91, ""], [None, text(30)], [None, None], [3, rows[3][1]], [3, text(25)], [92, text(20000)]]
    source = lambda i: None if i is None or i % 5 == 0 else "ab"[i % 2]
    docs = [(i, t, "en" if i else None, source(i), None if t is None else len(t), 1, "x", "y") for i, t in rows]
    labels = [(i, int(i < 60), 0) for i in range(90) if i % 3 == 0] + [(1, None, None), (None, 0, 1), (6, 1, 0)]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, items, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def without_lines(rows):
    earlier, out = [], {}
    order = sorted((r for r in set(rows) if None not in r), key=lambda r: r[0])
    for i, t in order:  # rows that repeat id and text are cleaned alike; an id with two texts: one's lines must not hit the other here
        kept = []
        for line in t.split("\n"):
            w = words_of(line)
            if not w or not any(one_edit_within(x, w) for x in earlier):
                kept.append(line)
            if w:
                earlier.append(w)
        out[i, t] = "\n".join(kept)
    return sorted(((i, out.get((i, t), t)) for i, t in rows), key=str)


def smallest_of_groups(rows):
    comp = {i: i for i, _ in rows if i is not None}
    near = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for a, x in sets for b, y in sets if near(x, y)]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((r for r in rows if r[0] is None or comp[r[0]] == r[0]), key=str)


def without_items(rows, items):
    ids = {}
    code = lambda t: np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.uint64)
    own = [code(t) for _, t in items if t]
    bad = {t for _, t in rows for w in own if t and decontamination.edit_distance(w, code(t))[0] <= int(0.15 * len(w))}
    return sorted((r for r in rows if r[1] not in bad), key=str)


def test_every_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, items, _ = corpus()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test")
        kept[name] = (before, texts(docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    before, after = kept["quality classifier"]
    ids = {i for i, _ in after}
    assert set(after) <= set(before) and set(range(60)) <= ids and len(ids & set(range(60, 90))) <= 3
    before, after = kept["line dedup"]
    assert after == without_lines(before) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    before, after = kept["minhash near-dedup"]
    assert after == smallest_of_groups(before)
    before, after = kept["benchmark decontamination"]
    assert after == without_items(before, items) and 43 not in dict(after)
    before, after = kept["mixing sources to target weights"]
    rows = docs.collect()
    assert set(after) <= set(before) and all(r.taken <= 2 * r.size and r.size == len((r.text or "").split()) for r in rows)
    source = {(r[0], r[3]) for r in corpus()[0]}
    sizes = {}
    for i, t in before:
        s = next(s for d, s in source if d == i)
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for s, goal in mixing.targets(sizes).items():
        taken = sum(r.taken for r in rows if r.source == s)
        assert goal - max((r.size for r in rows if r.source == s), default=0) <= taken <= goal + 0.5


def test_run_is_the_stages_and_repeats(spark, folder):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and a


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_base_columns_by_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        lines = [" ".join(rnd.choices(["a#", "b|c", "<d>", "é&", "plain", "words", "10%", "x"], k=rnd.randint(0, 9))) for _ in range(rnd.randint(1, 9))]
        rows.append((i, "\n".join(lines + lines[: rnd.randint(0, 3)]), 1, "k"))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, quality int, pattern string")).collect()}
    for i, t, *_ in rows:
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        assert (got[i].n_symbols, got[i].n_dup_lines) == (sum(t.count(c) for c in "#*$%&|<>"), again)


@pytest.mark.parametrize("share", [0.01, 0.05, 0.15])
def test_rules_posterior_of_rare_faults(share):
    """Faults that few texts have, each seen by one rule, lower the posterior below a half; good votes alone leave it high; rules that agree count more."""
    rng = np.random.default_rng(3)
    n = 20000
    code = (rng.random(n) < 0.95).astype(np.int64)
    for rule in (1, 2, 3):
        code += np.where(rng.random(n) < share, quality_rules.BAD, 0) * 3**rule
    patterns, counts = np.unique(code, return_counts=True)
    post = dict(zip(patterns.tolist(), quality_rules.fit(patterns, counts)))
    assert post[1] > 0.8 and all(post[1 + 2 * 3**r] < 0.2 for r in (1, 2, 3))
