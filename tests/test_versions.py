"""The versioned store: whole changes or none, patches, batches of spans in any cut, keyed reads."""

import json

import pytest

from runloom.operators import otlp
from runloom.sources.store import TraceStore


@pytest.fixture
def store(spark, tmp_path):
    return TraceStore(spark, str(tmp_path / "s"), buckets=4)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_every_valid_trace_is_stored_or_reported(spark, store):
    body = {"agent_name": "a", "steps": []}
    docs = [body | {"id": ""}, body | {"id": ""}, body | {"id": 7}, body | {"id": 7}, body, body, body | {"id": "x"}, body | {"id": "x"}, {"id": "y"}]
    faults = store.ingest(frame(spark, "doc_id int, body string", *((i, json.dumps(d)) for i, d in enumerate(docs))))
    assert rows(faults, "doc_id", "field") == [(7, "id"), (8, "agent_name")]
    ids = [r.id for r in store.table("traces").collect()]
    assert len(ids) == len(set(ids)) == 7 and "x" in ids and "7" not in ids
    again = store.ingest(frame(spark, "doc_id int, body string", (0, json.dumps(body)), (1, json.dumps(body | {"id": "x"}))))
    assert rows(again, "doc_id", "message") == [(1, "is taken")] and store.table("traces").count() == 8


def test_start_append_patch_attach(spark, store):
    started = frame(spark, "id string, agent_name string", ("t", "a"), ("t", "a"), ("u", "b"), (None, "c"), (" ", "c"))
    assert store.start(started).count() == 0
    assert rows(store.start(frame(spark, "id string, agent_name string", ("t", "z"))), "id") == [("t",)]
    assert [r.status for r in store.table("traces").collect()] == ["running"] * len({r.id for r in store.table("traces").collect()}) and store.table("traces").count() == 4
    schema = "trace_id string, step_number int, step_type string, name string, parent_step_number int, seq int"
    faults = store.append_steps(frame(
        spark, schema, ("t", 1, "thought", "n1", None, 1), ("t", 2, "tool_call", "n2", 1, 2), ("t", 2, "tool_call", "twice", 1, 3), ("t", 3, "output", "n3", 9, 4),
        ("no", 1, "thought", "x", None, 5), ("t", 4, "odd", "x", None, 6), ("t", 5, "output", " ", None, 7), ("t", 0, "output", "x", None, 8),
    ))
    assert rows(faults, "trace_id", "step_number", "message") == [
        ("no", 1, "no such trace"), ("t", 0, "step_number must be positive"), ("t", 2, "step_number is given more than once"), ("t", 4, "step_type is unknown"), ("t", 5, "name is missing"),
    ]
    assert rows(store.table("steps"), "step_number", "name", "parent_step_number") == [(1, "n1", None), (2, "n2", 1), (3, "n3", None)]
    patch = lambda *p: frame(spark, "trace_id string, step_number int, patch string, seq int", *p)
    faults = store.patch("steps", patch(
        ("t", 2, '{"output": {"k": 1}, "tokens_used": 5, "error": "oh"}', 1), ("t", 2, '{"error": null, "tokens_used": -3}', 3), ("t", 2, '{"error": "late", "model": "m"}', 2), ("t", 9, "{}", 4),
    ))
    assert rows(faults, "step_number", "message") == [(9, "is not there")]
    assert rows(store.table("steps").where("step_number = 2"), "output", "tokens_used", "error", "model", "name") == [('{"k":1}', None, None, "m", "n2")]
    ended = frame(spark, "id string, patch string, seq int", ("t", '{"status": "OK", "output": "done"}', 1), ("u", '{"status": "odd"}', 1))
    assert store.patch("traces", ended).count() == 0
    assert rows(store.table("traces").where("id in ('t', 'u')"), "id", "status", "output") == [("t", "completed", '"done"'), ("u", "failed", None)]
    late = frame(spark, schema, ("t", 7, "output", "x", None, 1))
    assert rows(store.append_steps(late), "message") == [("the trace is completed",)]
    assert store.patch("steps", patch(("t", 1, '{"output": "late result"}', 1))).count() == 0  # what is there may change all the same
    decide = lambda *d: frame(spark, "trace_id string, step_number int, chosen string, seq int", *d)
    assert rows(store.attach("decisions", decide(("t", 1, "x", 1), ("t", 1, "y", 2), ("t", 8, "z", 3))), "step_number") == [(8,)]
    store.attach("decisions", decide(("t", 1, "w", 1), ("t", 2, "v", 1)))
    assert rows(store.table("decisions"), "step_number", "chosen") == [(1, "w"), (2, "v")]


def test_a_crash_between_writes_loses_nothing(spark, store, monkeypatch):
    store.start(frame(spark, "id string, agent_name string", ("t", "a")))
    before = store.snapshot()
    step = frame(spark, "trace_id string, step_number int, step_type string, name string", ("t", 1, "thought", "n"))

    def stop(*_):
        raise RuntimeError("lost")

    for broken in ("_write", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(store, broken, stop)
            with pytest.raises(RuntimeError):
                store.append_steps(step)
        assert store.snapshot().version == before.version and store.table("steps").count() == 0 and store.table("traces").count() == 1
    assert store.append_steps(step).count() == 0 and store.table("steps").count() == 1
    assert before.table("steps").count() == 0  # an older version reads as it was
    assert store.vacuum(keep=1) >= 1 and store.table("steps").count() == 1 and store.table("traces").count() == 1


def test_two_writers(spark, store):
    """Another writer comes between reading and publishing: the work is done again on what it left."""
    other, calls = TraceStore(spark, store.root), []
    assert other.buckets == 64 and store.buckets == 4  # nothing is written yet
    store.start(frame(spark, "id string, agent_name string", ("a", "x")))
    other = TraceStore(spark, store.root)
    assert other.buckets == 4

    def work(snap):
        calls.append(snap.version)
        if len(calls) == 1:
            other.start(frame(spark, "id string, agent_name string", ("b", "x")))
        return {"traces": (frame(spark, "id string, agent_name string", (f"seen {snap.table('traces').count()}", "x")), None)}

    assert store.change(work) == 3 and calls == [1, 2]
    assert rows(store.table("traces"), "id") == [("a",), ("b",), ("seen 2",)]


def test_keyed_reads_open_one_bucket(spark, store):
    ids = [f"t{i}" for i in range(40)]
    store.start(frame(spark, "id string, agent_name string", *((i, "a") for i in ids)))
    store.append_steps(frame(spark, "trace_id string, step_number int, step_type string, name string", *((i, 1, "thought", "n") for i in ids)))
    one = store.trace("steps", "t7")
    assert rows(one, "trace_id") == [("t7",)] and len(one.inputFiles()) == 1 < len(store.table("steps").inputFiles())
    files = store.table("steps").inputFiles()
    store.patch("steps", frame(spark, "trace_id string, step_number int, patch string, seq int", ("t7", 1, '{"name": "new"}', 1)))
    assert len(set(store.table("steps").inputFiles()) - set(files)) == 1  # only its bucket was written anew
    for i in range(4):
        store.append("evals", frame(spark, "trace_id string, evaluator_name string", ("t7", str(i))))
    assert len(store.trace("evals", "t7").inputFiles()) == 4
    store.compact("evals", segments=2)
    assert len(store.trace("evals", "t7").inputFiles()) == 1 and rows(store.table("evals"), "evaluator_name") == [("0",), ("1",), ("2",), ("3",)]


def span(i, up="r", at=5, op="execute_tool", trace="T", tokens=0, session=None, error=False):
    attrs = [{"key": "gen_ai.operation.name", "value": {"stringValue": op}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": str(tokens)}}]
    attrs += [{"key": "gen_ai.conversation.id", "value": {"stringValue": session}}] * bool(session) + [{"key": "gen_ai.prompt", "value": {"stringValue": f"ask {i}"}}] * (op == "invoke_agent")
    return {
        "traceId": trace, "spanId": i, "parentSpanId": up, "name": i, "startTimeUnixNano": str(at * 10**9), "endTimeUnixNano": str((at + 1) * 10**9), "attributes": attrs,
        "status": {"code": 2 if error else 0},
    }


def batch(spark, seq, *spans):
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans)}]}]})
    return otlp.read_spans(spark.createDataFrame([(seq, body)], "seq long, body string"))


ROOT, CHAT, TOOL = span("r", "", 1, "invoke_agent", tokens=50), span("c", "r", 2, "chat", tokens=120), span("x", "c", 3)


def test_span_batches_in_any_cut(spark, tmp_path):
    want = None
    for k, parts in enumerate([[[ROOT, CHAT, TOOL]], [[TOOL], [CHAT], [ROOT]], [[CHAT], [CHAT, TOOL], [ROOT, CHAT], [ROOT]]]):
        store = TraceStore(spark, str(tmp_path / str(k)), 4)
        for seq, spans in enumerate(parts):
            store.merge_spans(batch(spark, seq, *spans))
        t = rows(store.table("traces"), "id", "agent_name", "status", "total_tokens", "input", "started_at", "total_duration_ms", "metadata")
        s = rows(store.table("steps"), "trace_id", "step_number", "name", "parent_step_number", "tokens_used")
        assert len(t) == 1 and t[0][3] == 170 and "synthetic" not in t[0][7] and [x[1:4] for x in s] == [(1, "c", None), (2, "x", 1)]
        want = want or (t, s)
        assert (t, s) == want
    store.merge_spans(batch(spark, 9, span("late", "x", 2.5, error=True)))
    assert rows(store.table("steps"), "step_number", "name", "parent_step_number") == [(1, "c", None), (2, "late", None), (3, "x", 1)]


def test_spans_find_a_stored_trace(spark, store):
    """By telemetry id, or by session and format where there is none; forks are no target, the earliest is; what is stored wins."""
    mine = {"agent_name": "mine", "input": {"p": 1}, "status": "completed", "total_tokens": 5, "metadata": {"otel_trace_id": "T", "deep": {"k": [1]}}, "started_at": "1970-01-01T00:00:02Z"}
    docs = [mine | {"id": "a", "steps": [{"step_number": 4, "step_type": "thought", "name": "own"}]}, mine | {"id": "later", "started_at": "1990-01-01T00:00:00Z"}]
    talk = {"agent_name": "s", "session_id": "S", "metadata": {"source_format": "otel"}}
    store.ingest(frame(spark, "doc_id int, body string", *((i, json.dumps({"steps": []} | d)) for i, d in enumerate([*docs, talk | {"id": "b"}]))))
    fork = frame(spark, "id string, agent_name string, session_id string, metadata string, parent_trace_id string, started_at string", ("f", "s", "S", '{"source_format": "otel"}', "b", "1900-01-01T00:00:00Z"))
    store.start(fork)
    store.merge_spans(batch(spark, 1, ROOT, CHAT, span("q", "", 9, session="S", trace="")))
    store.merge_spans(batch(spark, 2, TOOL, CHAT))
    t = {r.id: r for r in store.table("traces").collect()}
    assert set(t) == {"a", "later", "b", "f"} and (t["a"].agent_name, t["a"].input, t["a"].total_tokens) == ("mine", '{"p":1}', 175)
    assert json.loads(t["a"].metadata)["deep"] == {"k": [1]} and t["a"].started_at.startswith("1970-01-01T00:00:01")
    assert rows(store.table("steps"), "trace_id", "step_number", "name", "parent_step_number") == [("a", 4, "own", None), ("a", 5, "c", None), ("a", 6, "x", 5), ("b", 1, "q", None)]
    store.delete(frame(spark, "id string", ("b",)))
    assert rows(store.table("traces"), "id", "parent_trace_id") == [("a", None), ("f", None), ("later", None)] and store.table("spans").where("trace_id = 'b'").count() == 0
    store.merge_spans(batch(spark, 3, span("q", "", 9, session="S", trace="")))  # nothing is left to merge into
    assert store.table("traces").count() == 4


def test_forks_in_the_store(spark, store):
    step = lambda n, **more: {"step_number": n, "step_type": "thought", "name": f"n{n}"} | more
    trace = {"id": "a", "agent_name": "x", "status": "failed", "error": "e", "tags": ["p"], "metadata": {"m": [1]}, "input": {"i": 1}, "steps": [
        step(1, decision={"chosen": "c"}, snapshot={"context_window": {"w": 1}}), step(3, parent_step=1), step(4, snapshot={"context_window": {"w": 4}, "token_count": 7}),
    ]}
    store.ingest(frame(spark, "doc_id int, body string", (0, json.dumps(trace)), (1, json.dumps({"id": "b", "agent_name": "x", "steps": []}))))
    points = frame(spark, "id string, at int", ("a", 3), ("a", 4), ("a", 2), ("b", 1), ("no", 1), ("a", 3))
    faults = store.fork(points, "2024-01-01T00:00:00Z", context='{"mine": 1}', tag="t")
    assert rows(faults, "id", "at", "message") == [("a", 2, "no such step to fork at"), ("b", 1, "no such trace, or one without steps"), ("no", 1, "no such trace, or one without steps")]
    made = {json.loads(r.metadata)["forked_at_step"]: r for r in store.table("traces").where("parent_trace_id = 'a'").collect()}
    assert set(made) == {3, 4} and {(r.status, r.error, r.input, tuple(r.tags), json.loads(r.metadata)["m"][0]) for r in made.values()} == {("running", None, '{"i":1}', ("p", "t"), 1)}
    of = lambda name, at, *cols: rows(store.table(name).where(f"trace_id = '{made[at].id}'"), *cols)
    assert of("steps", 3, "step_number", "parent_step_number") == [(1, None), (3, 1)] and of("decisions", 3, "chosen") == [("c",)]
    assert of("snapshots", 3, "step_number", "context_window", "token_count") == [(1, '{"w":1}', 0), (3, '{"mine": 1}', 0)]
    assert of("snapshots", 4, "step_number", "context_window", "token_count") == [(1, '{"w":1}', 0), (4, '{"mine": 1}', 7)]


def test_merging_spans_leaves_only_the_store_on_disk(spark, tmp_path, monkeypatch):
    def refuse(df):
        raise AssertionError("a checkpoint is never removed")

    monkeypatch.setattr("runloom.sources.store.cut", refuse)
    store = TraceStore(spark, str(tmp_path), 4)
    store.merge_spans(batch(spark, 0, TOOL, CHAT, ROOT))
    assert not [f for f in (tmp_path / "_interim").rglob("*") if f.is_file()]
    assert store.table("steps").count() == 2
