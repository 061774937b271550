from runloom.operators import compare
from runloom.sources.fixtures import TRACE, Store


def test_steps_are_numbered_before_texts_are_made(spark):
    plan = Store(spark, "/root/testdata/sf0.001").steps._jdf.queryExecution().optimizedPlan().toString()
    assert "answer" not in plan[plan.index("Window [row_number()") :]


def test_steps_are_dealt_once_by_trace(spark):
    s = Store(spark, "/root/testdata/sf0.001")
    rows = compare.golden_steps(s.steps.where("trace_key % 2 = 0"))
    plan = rows._jdf.queryExecution()
    dealt = [x for x in plan.executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "% 2" not in plan.optimizedPlan().toString().split("Window [row_number()")[0]
    assert s.steps.where("concat('trc_', cast(trace_key as string)) <> trace_id").count() == 0


def test_heads_are_traces_without_a_look_at_line_items(spark):
    s = Store(spark, "/root/testdata/sf0.001")
    assert not s.heads.columns[len(TRACE) :] and not [x for x in s.heads.inputFiles() if "lineitem" in x]
    assert s.heads.exceptAll(s.traces.select(*TRACE)).isEmpty() and s.heads.count() == s.traces.count()
