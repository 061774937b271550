"""Exits, responses and finished processes where fields are missing; standing totals after every batch."""

import json

from runloom.operators import browse, enforce
from runloom.streaming import totals


def test_exits_and_responses_without_fields(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("deny", None, None, None, None), ("require_review", "gemini", "e", None, None), ("warn", "crush", "e", "p", None)],
                               "verdict string, dialect string, event_name string, policy string, reason string")
    assert [(r.final, r.exit_code) for r in enforce.exits(df, interactive=True).collect()] == [("allow", 0), ("deny", 2), ("deny", 2), ("warn", 0)]
    got = [(r.stdout, r.stderr, r.exit_code) for r in enforce.responses(df).collect()]
    assert got == [(None, None, 0), (None, "blocked by policy", 2), ('{"decision":"deny","reason":"review required: blocked by policy"}', None, 0), (None, None, 0)]


def test_finalised_keeps_what_is_not_its_own(spark):
    schema = "id string, status string, ended_at string, total_duration_ms long, error string, metadata string, extra int"
    traces = spark.createDataFrame([("a", "running", None, None, None, "no json", 1), ("b", "completed", "x", 7, None, '{"k":{"z":[1]},"exit_code":9}', 2), ("c", "running", None, None, "e", "{}", 3)], schema)
    runs = spark.createDataFrame([("a", 1000, 3000, None, "SIGODD", None, None), ("b", 0, 5, 3, None, True, None), ("gone", 0, 5, 3, None, None, None)],
                                 "id string, started_ms long, ended_ms long, code int, killed string, declared boolean, repaired boolean")
    got = {r.id: r for r in enforce.finalised(traces, runs).collect()}
    assert (got["a"].status, got["a"].ended_at, got["a"].total_duration_ms, json.loads(got["a"].metadata)) == ("completed", "1970-01-01T00:00:03.000Z", 2000, {"exit_code": 0})
    assert (got["b"].status, got["b"].total_duration_ms, json.loads(got["b"].metadata)) == ("completed", 7, {"k": {"z": [1]}, "exit_code": 3})
    assert tuple(got["c"]) == ("c", "running", None, None, "e", "{}", 3) and set(got) == {"a", "b", "c"}


def test_standing_totals_after_every_batch(spark, tmp_path):
    schema = "id string, agent_name string, status string, parent_trace_id string, step_count bigint, duration_ms bigint, effective_tokens bigint, total_cost_usd double"
    batches = [
        [("1", "a", "completed", None, 2, 10, 5, 0.5), ("2", "a", "failed", None, 1, None, None, None)], [("3", None, "running", None, 0, None, 1, 0.25), ("4", "a", "failed", "1", 9, 9, 9, 9.0)],
        [("5", "b", "timeout", None, 3, 31, 2, None)],
    ]
    paths = [str(tmp_path / n) for n in ("in", "out", "cp")]
    seen = []
    for b in batches:
        seen += b
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(paths[0])
        totals.keep(spark.readStream.schema(schema).parquet(paths[0]), *paths[1:]).awaitTermination()
        now, every = totals.groups(spark, paths[1]), spark.createDataFrame(seen, schema)
        for f in ("store_totals", "status_counts", "agent_counts"):
            got, want = getattr(totals, f)(now), getattr(browse, f)(every)
            assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str), f
