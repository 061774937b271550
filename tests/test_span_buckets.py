"""Streamed spans are dealt by bucket of traces: a bucket's traces share the calls of its state, and none changes another's steps."""

from pyspark.sql import Row

from runloom.streaming import stateful


class Spans(dict):
    calls = 0

    def iterator(self):
        self.calls += 1
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v


class Handle:
    def getMapState(self, *_):
        return Spans()


def span(trace_id, span_id, at):
    none = dict.fromkeys(("parent_id", "input", "output", "tokens", "model", "error", "metadata"))
    return Row(**none, trace_id=trace_id, span_id=span_id, place=f"{at:04}", start_ms=at, end_ms=at, step_type="thought", step_name=span_id)


def test_traces_of_a_bucket_share_calls_of_the_state():
    p = stateful.SpanSteps()
    p.init(Handle())
    first = list(p.handleInputRows((7,), iter([span(f"t{i % 50}", f"s{i}", 100 + i) for i in range(100)]), None))
    assert len(first) == 100 and {r.step_number for r in first} == {1, 2} and p.spans.calls == 2
    late = list(p.handleInputRows((7,), iter([span("t3", "s0", 1), span("t4", "s4", 104)]), None))
    assert sorted((r.trace_id, r.step_number, r.version) for r in late) == [("t3", 1, 2), ("t3", 2, 2), ("t3", 3, 2)] and p.spans.calls == 4
    assert list(p.handleInputRows((7,), iter([span("t3", "s0", 1)]), None)) == [] and p.spans.calls == 5
