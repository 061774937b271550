"""The set-wise step tree against a walk by hand."""

import random

from runloom.operators import graph

SCHEMA = "trace_id string, step_number int, parent_step_number int"


def walked(steps):
    """Pre-order of (number, parent): what no root reaches begins anew at the smallest that is left."""
    known, below, roots, out = dict(steps), {}, [], []
    for n, p in sorted(steps):
        if p is not None and p in known and p != n:
            below.setdefault(p, []).append(n)
        else:
            roots.append(n)
    seen = set()
    for root in roots + sorted(known):
        todo = [(root, 0)]
        while todo:
            n, depth = todo.pop()
            if n not in seen:
                seen.add(n)
                out.append((n, depth, len(out)))
                todo += [(c, depth + 1) for c in reversed(below.get(n, []))]
    return out


def test_against_a_walk(spark):
    rnd, shapes = random.Random(5), {}
    for i in range(20):
        n = rnd.randint(1, 30)
        numbers = rnd.sample(range(1, 100), n)
        any_ = [None, 0, -1, 500, *numbers]
        shapes[f"any{i}"] = [(k, rnd.choice(any_)) for k in numbers]  # missing parents, own ones, forward ones and circles
        shapes[f"tree{i}"] = [(k, rnd.choice([None, *range(1, k)])) for k in range(1, n + 1)]
    shapes |= {"circle": [(i, i % 9 + 1) for i in range(1, 10)], "under": [(5, 6), (6, 5), (3, 5), (4, 3), (9, 3), (1, 4)], "self": [(1, 1), (2, 1)]}
    shapes["chain"] = [(i, i - 1 or None) for i in range(1, 130)]
    shapes["fan"] = [(1, None)] + [(i, 1) for i in range(2, 130)]
    rows = [(t, n, p) for t, s in shapes.items() for n, p in s]
    rnd.shuffle(rows)
    df = graph.step_tree(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {}
    for r in df.collect():
        got.setdefault(r.trace_id, []).append((r.step_number, r.depth, r.position))
    for t, s in shapes.items():
        assert sorted(got[t], key=lambda x: x[2]) == walked(s), t


def test_no_trace_is_gathered(spark):
    df = graph.step_tree(spark.createDataFrame([("t", 1, None)], SCHEMA))
    assert "collect" not in df._jdf.queryExecution().toString() and [tuple(r) for r in df.collect()] == [("t", 1, 0, 0)]
    assert graph.step_tree(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_traces_are_walked_where_they_lie_and_long_ones_joined(spark):
    rnd = random.Random(6)
    shapes = {f"t{i}": [(k, rnd.choice([None, 0, 77, *range(1, 12)])) for k in rnd.sample(range(1, 40), rnd.randint(1, 12))] for i in range(60)}
    shapes["long"] = [(i, i // 2 or None) for i in range(1, 50)]
    rows = [(t, n, p) for t, s in shapes.items() for n, p in s] + [("t0", None, 1), ("t0", None, None), (None, 1, None), (None, 2, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    get = lambda whole: sorted(map(tuple, graph.step_tree(df, whole).collect()), key=str)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # traces go on over batches
    try:
        assert get(10_000) == get(6) == get(0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree", "")
    graph.step_tree(df).collect()
    n = len(jobs.getJobIdsForGroup("tree"))
    spark.sparkContext.setJobGroup("", "")
    assert n < 12  # no rounds of joins
