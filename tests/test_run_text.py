import random
import re

import pytest

from runloom.operators import judge, run_text

PATTERNS = {
    "two": "ab", "some": "a{2,3}b", "word": r"\bfoo\b", "gap": "a b", "blank": r"\s", "seam": r'b" "a', "odd": r"o[^b]{1,5}b", "far": "f.*b.*f", "begin": '^"', "end": 'b$',
    "look": "(?=ab)ab", "behind": "(?<=a) a", "many": r"(a |b ){2,3}", "not_word": r"\Boo\b", "either": "oab|b fo", "none": "zz",
}


def test_reach():
    width = {n: run_text.reach(p).width for n, p in PATTERNS.items()}
    assert (width["two"], width["some"], width["word"], width["odd"], width["many"], width["either"]) == (2, 4, 3, 7, 6, 4)
    assert [n for n, w in width.items() if w is None] == ["far", "begin", "end", "look", "behind"]
    assert run_text.reach(r"\p{L}x") == run_text.Reach(None, False) and run_text.reach("a{3000}").width is None and run_text.reach("(?x)a b").width is None


@pytest.mark.parametrize("places", [16, 1 << 20])
def test_equal_to_the_runs_put_together(spark, monkeypatch, places):
    monkeypatch.setattr(run_text, "PLACES", places)
    rng = random.Random(places)
    runs = {}
    for k in range(150):
        texts = ["".join(rng.choice(["a", "b", "A", "foo", " ", '"', "xo", 'b" "a']) for _ in range(rng.choice([0, 1, 1, 2, 4, 9]))) for _ in range(rng.randint(1, 12))]
        runs[f"t{k}"] = texts
    rows = [(t, i * 7, x) for t, texts in runs.items() for i, x in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.trace_id: r for r in run_text.found(spark.createDataFrame(rows, "trace_id string, place long, text string"), PATTERNS).collect()}
    seen = dict.fromkeys(PATTERNS, 0)
    for t, texts in runs.items():
        for n, p in PATTERNS.items():
            want = re.search(p, " ".join(texts), re.I) is not None
            seen[n] += want
            assert got[t][n] == want, (n, p, texts)
    assert got.keys() == runs.keys()
    assert not [n for n in ("two", "some", "word", "seam", "odd", "far", "begin", "end", "many") if not 0 < seen[n] < len(runs)]


@pytest.mark.parametrize("many", [1, 20, 45])
def test_long_runs_are_stitched_beside_others(spark, monkeypatch, many):
    monkeypatch.setattr(run_text, "MANY", many)
    rng, runs = random.Random(many), {}
    for k in range(120):
        runs[f"t{k}"] = ["".join(rng.choice(["a", "b", "foo", " ", '"', "xo"]) for _ in range(rng.choice([0, 1, 2, 4, 9]))) for _ in range(rng.randint(1, 12))]
    rows = [(t, i * 7 - (k % 5 == 0) * 30, x) for k, (t, texts) in enumerate(runs.items()) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.trace_id: r for r in run_text.found(spark.createDataFrame(rows, "trace_id string, place long, text string"), PATTERNS).collect()}
    assert got.keys() == runs.keys()
    for t, texts in runs.items():
        for n, p in PATTERNS.items():
            assert got[t][n] == (re.search(p, " ".join(texts), re.I) is not None), (n, p, texts)


def test_short_runs_are_dealt_once(spark):
    rows = spark.createDataFrame([("t", 0, "ab"), ("t", 1, "cd")], "trace_id string, place long, text string")
    plan = run_text._near(rows, {"x": run_text.reach("b c")}, {"x": "b c"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Join" not in plan and [r.x for r in run_text.found(rows, {"x": "b c"}).collect()] == [True]


def test_rubric_across_steps(spark):
    """What is expected is sought in outputs in the order of their numbers, what is not also over names, inputs and errors; a trace without steps has its own texts."""
    traces = spark.createDataFrame([("a", '"in"', '"done"', 'say "no"'), ("b", None, None, None)], "id string, input string, output string, error string")
    steps = spark.createDataFrame(
        [("a", 2, "sh", '"-rf"', '"two"', None), ("a", 1, "rm", '"x"', '"one"', "bad")], "trace_id string, step_number int, name string, input string, output string, error string"
    )
    rules = [
        judge.Criterion("order", 'done" "one" "two', True), judge.Criterion("back", 'two" "one', True), judge.Criterion("inputs_no", '"two" "in"', True), judge.Criterion("input_yes", '"two" "in"', False),
        judge.Criterion("steps", '"bad" sh "-rf" ""', False), judge.Criterion("error", r'"say \\"no\\"" rm', False), judge.Criterion("end", '"-rf" ""$', False), judge.Criterion("start", '^"done', True),
    ]
    out = {r.trace_id: r.asDict() for r in judge.eval_rubric(traces, steps, rules, 0.5).collect()}
    assert [out["a"][c.name] for c in rules] == [1, 0, 0, 0, 0, 0, 0, 1] and [out["b"][c.name] for c in rules] == [0, 0, 0, 1, 1, 1, 1, 0]
