from runloom.operators import compare
from runloom.plans import queries
from runloom.sources.fixtures import Store


def test_decisions_meet_the_steps_of_pairs_only(spark):
    steps = "trace_id string, step_number int, step_type string, name string, input string, output string, model string, error string"
    rows = [(t, 1, "output", "n", "{}", None, None, None) for t in "abc"]
    steps = spark.createDataFrame(rows, steps)
    traces = spark.createDataFrame([(t, "{}", "failed", None, None) for t in "abc"], "id string, input string, status string, error string, output string")
    decisions = spark.createDataFrame([("a", 1, "x", None, "u"), ("b", 1, "y", None, "u")], "trace_id string, step_number int, chosen string, rationale string, decided_by string")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, left_id string, right_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = compare.diff(traces, steps, pairs, None, decisions)
        dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(trace_id" in x]
        got = out.select("step_number", "field").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "step_number" in dealt[0]  # the outer join is that with decisions; that with pairs lies beneath it
    assert [tuple(r) for r in got] == [(1, "decision")]


def test_forks_are_compared_without_the_ends_of_traces(spark):
    plan = queries.run_diff(Store(spark, "/root/testdata/sf0.001"), ["model"])._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x]) == 2  # steps, and the decisions made of them
