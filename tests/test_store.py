import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from runloom.functions import jsons, times
from runloom.operators import compare, export, imports, judge
from runloom.sources.store import TraceStore

TRACE = {
    "id": "t1", "agent_name": "a", "status": "completed", "input": {"b": 1, "a": [1.0, {"y": 2, "x": 1}]}, "output": "done", "tags": ["x"],
    "metadata": {"status": "mine", "k": 1},
    "steps": [
        {"step_number": 1, "step_type": "tool_call", "name": "look", "input": {"q": 1}, "tokens_used": 5},
        {"step_number": 3, "step_type": "decision", "name": "pick", "decision": {"chosen": "x", "options": [{"option": "x"}]}, "parent_step": 1,
         "snapshot": {"context_window": {"c": 1}, "token_count": 9}},
    ],
}


@pytest.fixture
def store(spark, tmp_path):
    s = TraceStore(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    bad = TRACE | {"id": "t2", "steps": [{"step_number": 0, "step_type": "odd", "name": ""}]}
    fork = TRACE | {"id": "t3", "steps": []}
    (tmp_path / "in" / "a.jsonl").write_text("// note\n\n" + json.dumps(TRACE) + "\nno json\n" + json.dumps(bad) + "\n")
    (tmp_path / "in" / "b.json").write_text(json.dumps([fork, TRACE], indent=2))
    faults, lines = s.ingest_files(str(tmp_path / "in"), ["extra"])
    assert sorted(r.field for r in faults.collect()) == ["id", "steps[0].name", "steps[0].step_number", "steps[0].step_type"]  # t1 is in both files
    assert [r.n for r in lines.collect()] == [4]
    return s


def test_ingest_and_read_again(store):
    assert sorted(r.id for r in store.table("traces").collect()) == ["t1", "t3"]
    t = store.table("traces").where("id = 't1'").first()
    assert t.tags == ["x", "extra"] and t.output == '"done"' and json.loads(t.input) == TRACE["input"]
    steps = store.table("steps").orderBy("step_number").collect()
    assert [(r.step_number, r.name, r.parent_step_number) for r in steps] == [(1, "look", None), (3, "pick", 1)]
    assert store.table("decisions").first().decided_by == "agent" and store.table("snapshots").first().token_count == 9
    docs = store.spark.createDataFrame([("d", json.dumps(TRACE))], "doc_id string, body string")
    assert [tuple(r) for r in store.ingest(docs).collect()] == [("d", "id", "is taken")]  # an id that is there is not written again
    assert store.table("traces").count() == 2 and store.table("steps").count() == 2


def test_export_golden_and_check(store, tmp_path):
    traces, steps = store.table("traces"), store.table("steps")
    store.add_evals(traces.select(F.col("id").alias("trace_id"), F.lit(1.0).alias("score"), F.lit(True).alias("passed")), "mine", 5)
    golden = export.golden_rows(traces, steps, store.table("evals"))
    export.write_golden(golden, str(tmp_path / "golden"))
    back = export.read_golden(store.spark, str(tmp_path / "golden"))
    meta = json.loads(back.where("id = 't1'").first().metadata)
    assert meta["status"] == "completed" and meta["trace_metadata_status"] == "mine" and meta["k"] == 1
    gt, gs = export.golden_tables(back)
    gs = gs.withColumn("input", jsons.canonical(F.col("input")))
    g = compare.golden_entries(gt, gs.withColumn("step_number", F.col("step_number")))
    rows = compare.golden_steps(steps)
    entries = compare.golden_entries(traces, rows)
    checked = compare.check_golden(g, gs, entries, rows)
    assert all(r.passed and r.golden_id for r in checked.collect())
    compare.refuse(g, entries, checked)
    with pytest.raises(ValueError):
        compare.refuse(g.limit(0), entries, checked)
    with pytest.raises(ValueError):
        compare.check_golden(g, gs, entries, rows, fields=["odd"])
    out = json.loads(export.export_rows(traces, steps, store.table("decisions"), store.table("evals")).where("id = 't1'").first().json)
    assert [s["step_number"] for s in out["steps"]] == [1, 3] and out["steps"][1]["decision"]["chosen"] == "x" and len(out["evals"]) == 1
    empty = export.export_rows(traces.limit(0), steps)
    export.write_jsonl(empty, str(tmp_path / "none"))
    assert store.spark.read.text(str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text('[{"id": "x", "agent_name": "a"}]')
    with pytest.raises(ValueError):
        export.read_golden(store.spark, str(tmp_path / "bad.json"))


def test_delete_cascades(store):
    child = store.table("traces").where("id = 't3'").withColumn("id", F.lit("t4")).withColumn("parent_trace_id", F.lit("t1"))
    store.append("traces", child)
    store.delete(store.spark.createDataFrame([("t1",)], "id string"))
    assert {r.id: r.parent_trace_id for r in store.table("traces").collect()} == {"t3": None, "t4": None}
    assert store.table("steps").count() == store.table("decisions").count() == store.table("snapshots").count() == 0


def test_policies(store):
    store.add_policy("b", "deny", {"name_contains": "look"}, 5)
    store.add_policy("a", "warn", {"step_type": "decision"}, 5)
    for name, action, pattern in (("a", "deny", {"name_contains": "x"}), ("c", "odd", {"name_contains": "x"}), ("c", "deny", {}), ("c", "deny", {"name_contains": " "}),
                                  ("c", "deny", {"name_regex": "(a+)+$"}), ("c", "deny", {"odd": "x"}), ("c", "deny", {"step_type": "odd"})):
        with pytest.raises(ValueError):
            store.add_policy(name, action, pattern)
    assert [p.name for p in store.policies()] == ["a", "b"]
    got = {(r.step_number, r.policy) for r in judge.guard_matches(store.table("steps"), store.policies()).collect()}
    assert got == {(1, "b"), (3, "a")}
    store.change_policy("b", False)
    assert [p.enabled for p in store.policies()] == [True, False]
    assert {r.verdict for r in judge.enforced(store.table("steps"), [p for p in store.policies() if p.name == "b"]).collect()} == {"deny"}
    store.change_policy("b", None)
    with pytest.raises(ValueError):
        store.change_policy("b", True)


def test_import_identity(spark):
    stored = spark.createDataFrame(
        [("old", None, "s1", "f", "x.jsonl"), ("forked", None, "s2", "f", "y.jsonl"), ("kid", "forked", "s2", "f", "y.jsonl")],
        "id string, parent_trace_id string, session_id string, source_format string, source_file string",
    )
    new = spark.createDataFrame([("s1", "f", "x.jsonl"), ("s2", "f", "y.jsonl"), (None, "f", "z.jsonl")], "session_id string, source_format string, source_file string")
    names = lambda df: sorted(r.source_file for r in df.collect())
    write, gone = imports.replaced(stored, new)
    assert names(write) == ["z.jsonl"] and gone.count() == 0
    write, gone = imports.replaced(stored, new, replace=True)
    assert names(write) == ["x.jsonl", "z.jsonl"] and [r.id for r in gone.collect()] == ["old"]


def test_subagents_of_transcripts(spark):
    line = lambda role, *content: json.dumps({"type": role, "sessionId": "s", "timestamp": "t", "message": {"content": list(content)}})
    rows = [
        ("f", None, 1, line("user", {"type": "text", "text": "<env>"})), ("f", None, 2, line("user", {"type": "text", "text": "do it"})),
        ("f", None, 3, line("assistant", {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "1", "name": {"odd": 1}, "input": {}})),
        ("f", None, 4, line("user", {"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "oh"}], "is_error": True})),
        ("f", "sub", 1, line("assistant", {"type": "text", "text": "I helped"})), ("g", None, 1, json.dumps({"type": "summary"})),
    ]
    got = imports.transcripts(spark.createDataFrame(rows, "file string, agent string, n int, line string"))
    assert [(r.file, r.prompt, r.preamble, r.steps, r.imported, r.skipped) for r in got["traces"].collect()] == [("f", "do it", ["<env>"], 4, 5, 0)]
    steps = got["steps"].orderBy("step_number").collect()
    assert [(r.step_type, r.name, r.error, r.parent_step_number) for r in steps] == [
        ("thought", "thinking", None, None), ("tool_call", "tool", "oh", None), ("thought", "subagent:sub", None, None), ("output", "assistant_message", None, 3),
    ]


def test_scalar_functions(spark):
    assert jsons.number_text(1e21) == "1e+21" and jsons.number_text(1e-7) == "1e-7" and jsons.number_text(0.000001) == "0.000001" and jsons.number_text(-0.0) == "0"
    assert jsons.canonical_text('{"b":1e3,"a":[1.0,null]}') == '{"a":[1,null],"b":1000}' and jsons.canonical_text("text") == '"text"'
    assert jsons.fold_text("Ａ​bC­") == "abc" and jsons.escape_text("a\x01\tb") == "a\\x01\tb" and jsons.escape_text("\t", True) == "\\x09"
    deep = "[" * 900 + '{"b":[],"a":{}}' + "]" * 900
    assert jsons.stable(jsons.parse(deep)) == deep.replace('"b":[],"a":{}', '"a":{},"b":[]')
    value = []
    for _ in range(5000):
        value = [value]
    assert jsons.stable(value) == "[" * 5001 + "]" * 5001
    assert list(jsons.strings_in({"a": ["x", {"b": "y"}], "c": 1})) == ["x", "y"]
    assert jsons.stored_text("[1]") == "[1]" and jsons.stored_text("42") == '"42"' and jsons.stored_text(None) is None
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert times.since_ms("1d", now) == 1704067200000 and times.since_ms("2024-01-01T02:00:00+0200") == 1704067200000 and times.duration_ms("1w") == 604800000
    for bad in ("", "5", "soon", "-1d"):
        with pytest.raises(ValueError):
            times.since_ms(bad)
    df = spark.createDataFrame([('{"a":1,"b":2}', '{"b":3}')], "x string, y string")
    assert json.loads(df.select(F.to_json(jsons.merged(F.col("x"), F.col("y")))).first()[0]) == {"a": 1, "b": 3}


@pytest.mark.parametrize("pattern, unsafe", [("(a+)+", True), ("(a|ab)*c", True), ("([a-z]+\\s*)*$", True), ("^rm\\s+-rf", False), ("(ab)+c", False), ("(ab?)+", False), ("(", True), ("a{2,5}", False)])
def test_unsafe_expressions(pattern, unsafe):
    assert judge.unsafe_regex(pattern) == unsafe


def test_policy_of_an_unusable_expression(spark):
    steps = spark.createDataFrame([("t", 1, "tool_call", "ｄｅｌｅｔｅ​_all", '{"c":"a\\nb"}', None)], "trace_id string, step_number int, step_type string, name string, input string, output string")
    policies = [
        judge.Policy("closed", "deny", name_regex="(a+)+"), judge.Policy("open", "warn", name_regex="(a+)+"), judge.Policy("fold", "warn", name_contains="delete_ALL"),
        judge.Policy("raw", "warn", input_contains="a\nb"), judge.Policy("python only", "deny", name_regex="(?P<x>zzz)"), judge.Policy("unknown", "deny", unknown_keys=True),
    ]
    assert {r.policy for r in judge.guard_matches(steps, policies).collect()} == {"closed", "fold", "raw", "python only", "unknown"}
