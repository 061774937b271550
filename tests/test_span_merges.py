"""What a merge of spans leaves on disk, and how often it deals them."""

import time

from runloom.operators import otlp
from runloom.sources.store import TraceStore

BODY = '{"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "%s", "spanId": "%s", "name": "chat x", "startTimeUnixNano": "%s", "endTimeUnixNano": "9000000"}]}]}]}'


def spans(spark, *rows):
    return otlp.read_spans(spark.createDataFrame([(i, BODY % r) for i, r in enumerate(rows)], "seq bigint, body string"))


def test_spans_that_come_again_write_nothing(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "s"), 4)
    store.merge_spans(spans(spark, ("a", "1", "2000000"), ("a", "2", "3000000"), ("b", "1", "1000000")))
    before = store.snapshot().manifest["tables"]
    store.merge_spans(spans(spark, ("a", "2", "5000000"), ("a", "1", "1000000")), lying=True)
    assert store.snapshot().manifest["tables"] == before
    store.merge_spans(spans(spark, ("a", "1", "2000000"), ("a", "0", "1000000")), lying=True)
    rows = store.table("steps").selectExpr("get_json_object(metadata, '$.otel_span_id') as id", "step_number", "trace_id").orderBy("trace_id", "step_number").collect()
    assert sorted((r.id, r.step_number) for r in rows) == [("0", 1), ("1", 1), ("1", 2), ("2", 3)]


def test_a_change_leaves_no_shuffle_files(spark, tmp_path):
    files = lambda: {f.getName() for f in list_(disk.getAllFiles())}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    list_ = lambda seq: [seq.apply(i) for i in range(seq.size())]
    shuffled = lambda: {n for n in files() if n.startswith("shuffle_")}
    store, before = TraceStore(spark, str(tmp_path / "s"), 4), shuffled()
    rows = spark.range(1000).selectExpr("concat('t', id % 7) as trace_id", "cast(id as int) as step_number", "'output' as step_type", "'n' as name")
    store.append("steps", rows.repartition(3, "trace_id"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and store.table("steps").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_steps_deal_their_spans_once(spark):
    plan = otlp.span_steps(spans(spark, ("a", "1", "1000000")))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 1
