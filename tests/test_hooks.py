import json

from pyspark.sql import functions as F

from runloom.functions import variants as V
from runloom.operators import hooks


def test_failure_flags(spark):
    rows = [json.dumps({"e": x}) for x in (False, 0, "", " ", [], {}, None, "bad", 3, True, ["x"], {"a": 1})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", V.parsed(F.col("x")).alias("v"))
    got = [r[0] for r in df.orderBy("i").select(hooks.failure_text(F.col("v"), "$.e")).collect()]
    assert got == [None] * 7 + ["bad", "3", "true", '["x"]', '{"a":1}']
    true = spark.createDataFrame([(json.dumps({"e": x}),) for x in (True, 1, " TRUE ", "1", "yes", 0, None)], "x string").select(V.parsed(F.col("x")).alias("v"))
    assert [r[0] for r in true.select(hooks.trueish(F.col("v"), "$.e")).collect()] == [True] * 4 + [False] * 3


def test_dialects(spark):
    cases = [
        ({"hook_event_name": "BeforeTool"}, "gemini", "pre_tool"), ({"hook_event_name": "Stop", "turn_id": 1}, "codex", "finalize"),
        ({"hook_event_name": "SessionEnd", "timestamp": "x"}, "gemini", "finalize"), ({"hook_event_name": "SessionEnd", "timestamp": "x", "permission_mode": "p"}, "claude-code", "finalize"),
        ({"hook_event_name": "Odd"}, "unknown", None), ({}, "unknown", None),
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(c[0])) for i, c in enumerate(cases)], "seq long, ms long, payload string")
    got = hooks.read_hooks(df).orderBy("seq").collect()
    assert [(r.dialect, r.action) for r in got] == [c[1:] for c in cases] and got[0].session == "unknown-session"
