import json

import pytest

from runloom.operators import ingest, judge, otlp


def span(ident, op, parent=None, tokens=None, **more):
    attrs = [{"key": "gen_ai.operation.name", "value": {"stringValue": op}}]
    if tokens is not None:
        attrs.append({"key": "gen_ai.usage.input_tokens", "value": {"intValue": str(tokens)}})
    out = {"traceId": "t", "spanId": ident, "name": op, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001000000000"}
    out |= {"attributes": attrs} | ({"parentSpanId": parent} if parent else {}) | more
    return out


def batch(*spans):
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}
    return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": spans}]}]})


def read(spark, *bodies):
    return otlp.read_spans(spark.createDataFrame(list(enumerate(bodies)), "seq bigint, body string"))


ROOT, CHAT, TOOL = span("r1", "invoke_agent", None, 50), span("c1", "chat", "r1", 120), span("t1", "execute_tool", "r1")
NEW = span("c2", "chat", "r1", 7)
MATRIX = [
    ([[ROOT, CHAT], [ROOT, CHAT]], (170, 1, False)),
    ([[ROOT, CHAT], [ROOT]], (170, 1, False)),
    ([[ROOT, CHAT], [CHAT, TOOL]], (170, 2, False)),
    ([[CHAT], [ROOT, CHAT]], (170, 1, False)),
    ([[CHAT], [ROOT]], (170, 1, False)),
    ([[CHAT], [TOOL]], (120, 2, True)),
    ([[ROOT, CHAT], [NEW]], (177, 2, False)),
    ([[ROOT, CHAT]] * 3, (170, 1, False)),
]


@pytest.mark.parametrize("batches, want", MATRIX)
def test_batches_in_any_delivery(spark, batches, want):
    out = ingest.assemble_spans(otlp.as_assembly(read(spark, *(batch(*b) for b in batches)))).collect()
    assert [(r.tokens, r.steps, r.synthetic) for r in out] == [want]


def test_spans_decoded(spark):
    thrown = [{"name": "exception", "attributes": [{"key": "exception.message", "value": {"stringValue": "boom"}}]}]
    twice = [{"key": "llm.token_count.total", "value": {"intValue": 1}}, {"key": "llm.token_count.total", "value": {"intValue": 9}}]
    rows = read(
        spark,
        batch(
            span("a", "chat", events=thrown), span("b", "chat", events=thrown, status={"code": "STATUS_CODE_OK"}),
            span("c", "chat", status={"code": 2, "message": ""}), span("d", "chat", None, -5),
            {"spanId": "e", "name": "plan the trip", "attributes": twice}, {"spanId": "e", "name": "constructor"},
            {"traceId": "t", "spanId": "f", "name": "x", "attributes": [{"key": "openinference.span.kind", "value": {"stringValue": "guardrail"}}]},
        ),
        "no json",
        "{}",
    ).collect()
    assert [r.error for r in rows] == ["boom", None, "error", None, None, None, None]
    assert [r.tokens for r in rows] == [0, 0, 0, 0, 9, 0, 0]
    assert [r.step_type for r in rows] == ["llm_call"] * 4 + ["thought", "thought", "guard_check"]
    assert rows[4].trace_id != rows[5].trace_id and rows[4].start_ms is None and rows[0].start_ms == 1_700_000_000_000
    assert rows[0].service == "s"


def test_rubric(spark):
    traces = spark.createDataFrame(
        [("a", '"x"', '"I am sorry"', None), ("b", '"say sorry"', None, "died"), ("c", None, None, None)], "id string, input string, output string, error string"
    )
    steps = spark.createDataFrame(
        [("a", "sh", '"rm -rf /"', None, None), ("b", "sorry", None, '"ok"', None)], "trace_id string, name string, input string, output string, error string"
    )
    rules = [judge.Criterion("sorry", "SORRY", True), judge.Criterion("rm", r"rm\s+-rf", False), judge.Criterion("bad", "[", False, 0.0)]
    out = {r.trace_id: r for r in judge.eval_rubric(traces, steps, rules, 0.5).collect()}
    assert (out["a"].sorry, out["a"].rm, out["a"].bad, out["a"].score, out["a"].passed) == (1, 0, 0, 0.5, True)
    assert (out["b"].sorry, out["b"].rm) == (0, 1) and (out["c"].sorry, out["c"].rm) == (0, 1)
    with pytest.raises(ValueError):
        judge.eval_rubric(traces, steps, [judge.Criterion("x", "x", True, -1.0)])


def test_rubric_parse():
    one = {"name": "x", "pattern": "y", "expected": True}
    assert judge.parse_rubric(json.dumps({"name": "r", "criteria": [one]})) == ("r", 0.7, [judge.Criterion("x", "y", True, 1.0)])
    for bad in ({"criteria": [one, one]}, {"criteria": []}, {"criteria": [one | {"weight": -1}]}, {"criteria": [one], "threshold": 2}):
        with pytest.raises(ValueError):
            judge.parse_rubric(json.dumps({"name": "r"} | bad))
