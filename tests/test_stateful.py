"""Keyed streams: the processors over every order of delivery, and real streams with timers."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from runloom.operators import otlp, validate
from runloom.streaming import stateful


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


class Map(dict):
    def containsKey(self, k):
        return k in self

    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """What a processor asks of Spark, for one key."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def expire(p, key, at):
    p.handle.timers.discard(at)  # as Spark does
    return list(p.handleExpiredTimer((key,), None, Now(at)))


class Now:
    def __init__(self, ms):
        self.ms = ms

    getCurrentProcessingTimeInMs = getExpiryTimeInMs = lambda self: self.ms


def kept(changes):
    """The last version of each row."""
    last = {}
    for r in changes:
        if (r.kind, r.step_number) not in last or last[r.kind, r.step_number].version < r.version:
            last[r.kind, r.step_number] = r
    return {k: json.loads(r.body) for k, r in last.items() if not r.gone}


def lines(rnd, n=40):
    kinds = ["trace_start", "step_start", "step_end", "step", "decision", "trace_end"]
    out = []
    for seq in range(n):
        kind = rnd.choices(kinds, [1, 6, 6, 4, 3, 0.7])[0]
        e = {"type": kind, "trace_id": "t", "agent_name": rnd.choice(["a", "b"])}
        if kind not in ("trace_start", "trace_end"):
            e |= {"step_number": rnd.randrange(1, 6), "step_type": "tool_call", "name": f"n{seq}", "chosen": f"c{seq}", "parent_step": rnd.choice([None, 1, 2])}
        for k, v in (("output", rnd.choice([None, f"o{seq}"])), ("tokens_used", rnd.choice([seq, None])), ("error", "e"), ("model", f"m{seq}"), ("total_tokens", seq), ("input", {"n": seq})):
            if rnd.random() < 0.4:
                e[k] = v
        if kind == "step" and rnd.random() < 0.5:
            e["decision"] = {"chosen": f"d{seq}", "confidence": 0.5}
        out.append((seq, json.dumps(e)))
    return out


@pytest.fixture(scope="module")
def streams(spark):
    """30 streams of events of one trace each: their patches, and what the batch fold makes of them."""
    rnd = random.Random(11)
    rows = [(seq, line.replace('"t"', f'"t{i}"'), i) for i in range(30) for seq, line in lines(rnd)]
    events = validate.read_events(spark.createDataFrame(rows, "seq long, line string, at int"))
    want = {k: {} for k in range(30)}
    for kind, df in validate.fold(events.drop("at")).items():
        for r in df.toJSON().collect():
            r = json.loads(r)
            t, n = int(r.pop("trace_id")[1:]), r.pop("step_number", None)
            want[t][kind[:-1], n] = r
    got = {k: [] for k in range(30)}
    for r in stateful.patches(events).collect():
        got[r["at"]].append(r)
    return got, want


def typed(rows):
    """Rows without nulls, numbers as numbers."""
    number = lambda v: float(v) if str(v).replace(".", "").lstrip("-").isdigit() else v
    return {k: {c: number(v) for c, v in r.items() if v is not None and not (k[0] == "step" and c == "decision")} for k, r in rows.items()}


@pytest.mark.parametrize("seed", range(4))
def test_any_order_and_cut_equals_the_batch_fold(streams, seed):
    got, want = streams
    rnd = random.Random(seed)
    assert sum(len(w) for w in want.values()) > 60
    for t, rows in got.items():
        p = stateful.TraceFold(1000)
        p.init(Handle())
        rows, out, at = rnd.sample(rows, len(rows)) if seed else rows, [], 0
        while at < len(rows):
            k = rnd.randint(1, 9)
            out += p.handleInputRows((f"t{t}",), iter(rows[at : at + k]), Now(0))
            at += k
        for due in list(p.handle.timers):
            out += expire(p, f"t{t}", due)
        assert typed(kept(out)) == typed(want[t])


def event(seq, kind, n=None, **fields):
    return Row(seq=seq, type=kind, step_number=n, patch=json.dumps(fields))


def test_a_silent_trace_times_out_and_takes_late_results():
    p = stateful.TraceFold(1000, retain_ms=5000)
    p.init(Handle())
    out = list(p.handleInputRows(("t",), iter([event(1, "trace_start", agent_name="a"), event(2, "step_start", 1, name="x")]), Now(100)))
    assert kept(out)["trace", None]["status"] == "running" and p.handle.timers == {1100}
    out += p.handleInputRows(("t",), iter([event(3, "step_start", 2, name="y")]), Now(600))
    assert p.handle.timers == {1600}  # an event puts the end off
    out += expire(p, "t", 1600)
    assert kept(out)["trace", None]["status"] == "timeout" and p.handle.timers == {6600}
    out += p.handleInputRows(("t",), iter([event(4, "step_start", 3, name="late"), event(5, "step_end", 2, output="done")]), Now(2000))
    rows = kept(out)
    assert ("step", 3) not in rows and rows["step", 2]["output"] == "done" and rows["trace", None]["status"] == "timeout"
    out += p.handleInputRows(("t",), iter([event(6, "trace_end", status="completed")]), Now(2500))
    assert kept(out)["trace", None]["status"] == "completed" and p.handle.timers == {7500}
    assert expire(p, "t", 7500) == [] and not p.head.exists() and not p.steps


def test_left_open_traces_and_those_that_never_began():
    p = stateful.TraceFold(1000, leave_open=True)
    p.init(Handle())
    list(p.handleInputRows(("t",), iter([event(2, "step_start", 1, name="x")]), Now(0)))
    assert p.handle.timers == {1000}  # its start may still come
    out = list(p.handleInputRows(("t",), iter([event(1, "trace_start", agent_name="a")]), Now(500)))
    assert p.handle.timers == set() and kept(out)["step", 1]["name"] == "x"
    q = stateful.TraceFold(1000)
    q.init(Handle())
    list(q.handleInputRows(("u",), iter([event(2, "step_start", 1, name="x")]), Now(0)))
    assert expire(q, "u", 1000) == [] and not q.head.exists() and not q.steps


def spans(spark):
    """A trace whose root, parents and copies come in any order."""
    one = lambda i, up, at, op: {
        "traceId": "t", "spanId": i, "parentSpanId": up, "name": i, "startTimeUnixNano": str(at * 10**6), "endTimeUnixNano": str((at + 5) * 10**6),
        "attributes": [{"key": "gen_ai.operation.name", "value": {"stringValue": op}}],
    }
    parts = [
        [one("r", "", 1, "invoke_agent")], [one("a", "r", 5, "chat"), one("b", "a", 6, "execute_tool")], [one("c", "b", 3, "execute_tool"), one("a", "r", 5, "chat")],
        [one("d", "z", 9, "chat"), one("z", "r", 8, "chat")],
    ]
    bodies = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": p}]}]}) for p in parts]
    return otlp.read_spans(spark.createDataFrame(list(enumerate(bodies)), "seq long, body string"))


def test_span_batches_in_every_order(spark):
    read = spans(spark)
    want = {r.pop("step_number"): r for r in (json.loads(x) for x in otlp.span_steps(read).drop("trace_id").toJSON().collect())}
    place = F.concat_ws(".", *(F.lpad(F.col(f"seq.{c}").cast("string"), 20, "0") for c in ("seq", "i", "j", "k")))
    batches = {}
    for r in read.withColumn("place", place).select("seq.seq", *(c.split()[0] for c in stateful.SPAN.split(", "))).collect():
        batches.setdefault(r["seq"], []).append(Row(**{k: v for k, v in r.asDict().items() if k != "seq"}))
    assert len(want) == 5
    for order in itertools.permutations(batches):
        p, out = stateful.SpanSteps(), []
        p.init(Handle())
        for b in order:
            out += p.handleInputRows(("t",), iter(batches[b]), None)
        assert list(p.handleInputRows(("t",), iter(batches[0]), None)) == []  # all known
        got = {n: {k: v for k, v in r.items() if v is not None} for (_, n), r in kept(out).items()}
        assert got == want


def test_a_real_stream_closes_silent_traces_by_the_clock(spark, tmp_path):
    rows = [(1, {"type": "trace_start", "trace_id": "a", "agent_name": "x"}), (2, {"type": "step", "trace_id": "a", "step_number": 1, "step_type": "output", "name": "n", "output": "o"}), (3, {"type": "trace_start", "trace_id": "b", "agent_name": "x"}), (4, {"type": "trace_end", "trace_id": "b"})]
    schema = "seq long, line string"
    spark.createDataFrame([(s, json.dumps(e)) for s, e in rows], schema).write.parquet(str(tmp_path / "in"))
    lines_ = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    changes = stateful.fold_stream(stateful.patches(validate.read_events(lines_)), 500)
    q = stateful.start(changes, str(tmp_path / "out"), str(tmp_path / "cp"), processingTime="200 milliseconds")
    status = {}
    try:
        for _ in range(120):
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists():
                status = {r.trace_id: r.status for r in stateful.current(spark, str(tmp_path / "out"), "trace", stateful.TRACE).collect()}
            if status.get("a") == "timeout":
                break
    finally:
        q.stop()
    assert status == {"a": "timeout", "b": "completed"}
    step = stateful.current(spark, str(tmp_path / "out"), "step", stateful.STEP).first()
    assert (step.trace_id, step.step_number, step.name, step.output) == ("a", 1, "n", '"o"')
