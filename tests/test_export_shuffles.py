from pyspark.sql import functions as F

from runloom.operators import export


def test_records_meet_their_steps_in_one_shuffle_of_the_steps(spark):
    traces = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    steps = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "trace_id string, step_number int, name string")
    made = "trace_id string, step_number int, options string, chosen string, rationale string, confidence double, decided_by string"
    decisions = spark.createDataFrame([("a", 2, "[]", "p", None, 0.5, "u"), ("b", 7, "[]", "q", None, 0.5, "u")], made)
    kept = "trace_id string, step_number int, context_window string, environment string, tool_state string, token_count bigint"
    snapshots = spark.createDataFrame([("a", 1, "w", "{}", "{}", 4), ("b", None, "w", "{}", "{}", 5)], kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = export.export_rows(traces, steps, decisions, None, snapshots)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "step_number" in x]
        get = lambda p: F.get_json_object("json", p)
        got = out.select("id", get("$.steps[*].name"), get("$.steps[*].decision.chosen"), get("$.steps[*].snapshot.token_count")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, got)) == [("a", '["x","y"]', '"p"', "4"), ("b", '"z"', None, None), ("c", None, None, None)]
