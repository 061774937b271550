"""What is read in a judge's reply."""

import pytest
from pyspark.sql import functions as F

from runloom.operators import replies


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', {"a": 1}), (' [1] ', [1]), ('Sure:\n```json\n{"a": 1}\n```', {"a": 1}), ('quoted ```{"a": 9}``` mine\n```\n{"a": 1}\n```', {"a": 1}),
    ('```json\n{"a": 1}\n``` and ```no json```', {"a": 1}), ('it says {"a": 9} but {"a": {"b": "}"}} is mine', {"a": {"b": "}"}}), ('{"a": 1} then {broken}', {"a": 1}),
    ('{"a": "\\"}{"} tail', {"a": '"}{'}), ('{"a": 1} and "an open {', {"a": 1}), ('{"a": NaN} {"b": 2}', {"b": 2}), ("} {\"a\": 1} {", {"a": 1}),
])
def test_answers(text, want):
    assert replies.answer(text) == want


@pytest.mark.parametrize("text", ["", "no", "{", '"an open {"a": 1}', "```\nx\n```", '"' * 99_999, "{" * 99_999])
def test_no_answer(text):
    with pytest.raises(ValueError, match="no JSON"):
        replies.answer(text)


def test_scores_never_pass_by_a_wrong_kind():
    assert [replies.number(x) for x in (5, "5", " 7.5 ", True, ["10"], None, "x", "", float("inf"), "1_0", {})] == [5, 5, 7.5, 0, 0, 0, 0, 0, 0, 0, 0]
    full = dict.fromkeys(replies.MARKS, 10)
    assert replies.score("ai-quality-review", full)[0] == 1 and replies.score("ai-quality-review", full | {"accuracy": [10]})[0] == 0.75 and replies.score("ai-quality-review", full | {"accuracy": 99})[0] == 1
    risk = lambda **d: (lambda s, x: (s, x["risk_level"]))(*replies.score("ai-security-audit", d))
    assert risk(risk_level="none", findings=[{"severity": "low"}, {"severity": "Critical"}, {"severity": "odd"}, 3]) == (0.0, "critical")
    assert risk(risk_level="HIGH", findings=[{"severity": "low"}]) == (0.2, "high") and risk() == (0.5, "medium") and risk(risk_level="odd") == (0.5, "odd") and risk(risk_level="none") == (1.0, "none")
    assert replies.score("ai-optimization", [1]) == (0.0, {"efficiency_score": 0.0})


def test_verdicts_and_an_injected_judge(spark):
    rows = [("a", "ai-optimization", "p1"), ("b", "ai-root-cause", "p2"), ("c", "odd", "p"), (None, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, preset string, prompt string")
    ask = lambda x: x.withColumn("reply", F.when(F.col("trace_id") == "a", '{"efficiency_score": "6"}').when(F.col("trace_id") == "b", "none"))
    got = [(r.trace_id, r.score, r.passed, r.error) for r in replies.judged(df, ask).collect()]
    assert got == [("a", 0.6, True, None), ("b", 0.0, False, "no JSON in the reply"), ("c", 0.0, False, "unknown preset odd"), (None, 0.0, False, "unknown preset None")]
    assert replies.verdicts(ask(df).limit(0)).count() == 0
