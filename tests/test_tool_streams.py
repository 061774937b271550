import json
import random

import pytest

from runloom.operators import tool_streams


def use(i, n):
    return {"type": "tool_use", "id": i, "name": n}


def res(i, n):
    return {"type": "tool_result", "id": i, "name": n}


def frame(spark, streams):
    rows = [(s, i, x if isinstance(x, str) else json.dumps(x)) for s, lines in streams.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "stream string, n long, line string")


def by_hand(lines):
    """Pairs by plain lists, line by line."""
    still, last, out = [], {}, []
    for i, x in enumerate(lines):
        if x["type"] == "tool_use":
            still.append((i, x["name"] or "tool"))
            if x["id"]:
                last[x["id"]] = i
            continue
        at = last.get(x["id"]) if x["id"] else None
        if at is None:
            fits = [k for k, name in still if x["name"] is None or name == x["name"]]
            at = fits[0] if fits else None
        if at is not None:
            out.append((at, i))
            still = [y for y in still if y[0] != at]
            last = {k: y for k, y in last.items() if y != at}
    return set(out)


def test_by_id_then_name_then_any(spark):
    lines = [use("a", "x"), use(None, "y"), use("c", "x"), res("c", "y"), res(None, "z"), res("q", "x"), res(None, None), res(None, None), use("d", "x")]
    got = tool_streams.pairs(frame(spark, {"s": lines, "t": [use("a", None), "no json"]})).collect()
    assert {(r.stream, r.open_n, r.close_n) for r in got} == {("s", 0, 5), ("s", 1, 6), ("s", 2, 3)}


@pytest.mark.parametrize("block", [3, 100_000])
def test_random_streams_equal_the_reading_by_hand(spark, block):
    """Streams with ids only, names only, neither, and mixes in which results take calls that an id wants later."""
    rng = random.Random(block)
    streams = {}
    for k in range(240):
        named, ids = rng.choice([(0, 1), (1, 1), (1, 0), (0, 0), (0.5, 0.5), (1, 0.6), (0, 0.6)]), "abcd"[: rng.randint(1, 4)]
        pick = lambda p, xs: rng.choice(xs) if rng.random() < p else None
        streams[f"s{k}"] = [
            use(pick(named[1], ids), rng.choice("xy")) if rng.random() < 0.55 else res(pick(named[1], ids + "q"), pick(named[0], "xyz")) for _ in range(rng.randint(1, 40))
        ]
    got = {}
    for r in tool_streams.pairs(frame(spark, streams), block).collect():
        got.setdefault(r.stream, []).append((r.open_n, r.close_n))
    for s, lines in streams.items():
        assert len(got.get(s, [])) == len(set(got.get(s, []))) and set(got.get(s, [])) == by_hand(lines), (s, lines)


def test_a_call_that_an_older_result_takes_is_read_in_order(spark):
    steal = [use("a", "x"), use(None, "x"), res(None, "x"), res("a", "x")]  # the first result takes the call of id a
    lost = [use("a", "x"), res(None, "x"), res("a", "x"), res("a", None)]
    again = [use("a", "x"), use("a", "x"), res("a", None), res("a", None)]
    empty = [{"type": "tool_use", "id": "", "name": ""}, res("", "")]
    streams = {"steal": steal, "lost": lost, "again": again, "empty": empty}
    got = {(r.stream, r.open_n, r.close_n) for r in tool_streams.pairs(frame(spark, streams)).collect()}
    assert got == {("steal", 0, 2), ("steal", 1, 3), ("lost", 0, 1), ("again", 1, 2), ("again", 0, 3), ("empty", 0, 1)}


def test_streams_read_in_order_stay_whole(spark):
    """Lines of a stream that lie in many partitions, as in large tables, go to one task."""
    rng = random.Random(1)
    streams = {f"s{k}": [use(rng.choice("ab"), rng.choice("xy")) if rng.random() < 0.5 else res(rng.choice("abq"), rng.choice("xyz")) for _ in range(60)] for k in range(40)}
    rows = tool_streams.cut(tool_streams._calls(frame(spark, streams)).repartition(8))
    odd = tool_streams.cut(rows.select("stream").distinct())
    tool_streams.ready()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        got = {(r.stream, r.open_n, r.close_n) for r in tool_streams._read(rows, odd).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(s, a, b) for s, lines in streams.items() for a, b in by_hand(lines)}


def test_steps_traces_and_skipped(spark):
    ok = [
        {"type": "init"}, use("a", "x") | {"input": {"q": 1}}, res("a", "x") | {"output": "fine", "error": ""}, use("b", "x"), res("b", None) | {"result": {"r": 2}, "is_error": "TRUE"},
        use(None, "y"), res("b", "zz"), {"type": "message", "content": [{"text": "a"}, "b"]}, {"type": "odd"}, "[1]",
        {"type": "result", "usage": {"total_tokens": "7", "input_tokens": 5}, "exit_code": "abc"}, {"type": "error", "message": "too late"},
    ]
    streams = {
        "ok": ok, "cut": [use("a", "x")], "bad": [{"type": "init"}, {"type": "error", "error": {"message": "boom"}}, {"type": "result", "code": 3}], "none": [{"type": "result"}],
        "exit": [{"type": "message", "text": "hi"}, {"type": "result", "exit_code": " 2 ", "stats": {"tokens": {"input_tokens": 2, "output_tokens": -1}}}],
    }
    got = tool_streams.tool_stream(frame(spark, streams), block=4)
    traces = {r.stream: (r.status, r.error, r.total_tokens, r.answer, r.steps) for r in got["traces"].collect()}
    assert traces == {
        "ok": ("completed", None, 7, "a\nb", 4), "cut": ("timeout", None, None, None, 1), "bad": ("failed", "boom", None, None, 0), "exit": ("failed", "exited with code 2", 2, "hi", 1),
    }
    steps = {r.step_number: (r.step_type, r.name, r.input, r.output, r.error) for r in got["steps"].where("stream = 'ok'").collect()}
    assert steps == {
        1: ("tool_call", "x", '{"q":1}', '{"output":"fine"}', None), 2: ("tool_call", "x", "{}", '{"r":2}', '{"r":2}'), 3: ("tool_call", "y", "{}", None, None),
        4: ("output", "message", None, '[{"text":"a"},"b"]', None),
    }
    assert {(r.n, r.reason) for r in got["skipped"].where("stream = 'ok'").collect()} == {(6, "no open call"), (8, "unknown type"), (9, "no object")}


def test_empty(spark):
    got = tool_streams.tool_stream(spark.createDataFrame([], "stream string, n long, line string"))
    assert all(got[k].count() == 0 for k in ("traces", "steps", "skipped"))
