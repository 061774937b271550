import json

from runloom.operators import otlp, validate


def once(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_traces_are_judged_in_one_reading(spark):
    """Traces are parsed once, their steps too; a trace without steps has none to fault."""
    step = {"step_number": 1, "step_type": "output", "name": "n", "parent_step": 7}
    rows = [(1, '{"agent_name": "a"}'), (2, '{"agent_name": "a", "steps": []}'), (3, json.dumps({"steps": [step, step | {"step_number": 2, "parent_step": 1}]}))]
    found = validate.validate(spark.createDataFrame(rows, "doc_id long, body string").repartition(2))
    assert once(found)
    assert {tuple(r) for r in found.collect()} == {
        (3, "agent_name", "is required and must be a string"), (3, "steps[0].parent_step", "must name an earlier step"), (3, "steps[0].parent_step", "names a step that is not there"),
    }


def test_span_steps_read_the_batches_once(spark):
    span = lambda i, up, at: {"traceId": "t", "spanId": i, "parentSpanId": up, "name": i, "startTimeUnixNano": str(at * 1_000_000), "endTimeUnixNano": str(at * 1_000_000)}
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span("a", None, 1), span("b", "a", 2), span("c", "a", 3), span("d", "e", 4), span("e", "zz", 5)]}]}]})
    steps = otlp.span_steps(otlp.read_spans(spark.createDataFrame([(1, body), (2, body)], "seq long, body string").repartition(2)))
    assert once(steps)
    assert {r.name: (r.step_number, r.parent_step_number) for r in steps.collect()} == {"a": (1, None), "b": (2, 1), "c": (3, 1), "d": (4, None), "e": (5, None)}
