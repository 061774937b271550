"""Antecedents of steps with gaps, repeated and missing numbers against a search by hand."""

import random

from runloom.operators import graph

SCHEMA = "trace_id string, step_number int, step_type string, parent_step_number int, caused_by_step_number int"


def test_antecedents_against_a_search(spark):
    rnd, rows = random.Random(2), []
    for t in range(60):
        n = rnd.randint(1, 12)
        numbers = sorted(rnd.sample(range(-1, 15), n)) if t % 3 else list(range(t % 4, t % 4 + n))
        ref = lambda: rnd.choice([None, *range(-2, 16)])
        rows += [(f"t{t}", k, rnd.choice(["decision", "output"]), ref(), ref()) for k in numbers]
        if t % 5 == 0:
            rows.append((f"t{t}", numbers[-1], "output", ref(), ref()))
        if t % 7 == 0:
            rows.append((f"t{t}", None, "output", 1, 2))
    have, want = {(r[0], r[1]) for r in rows}, []
    for t, k, _, parent, cause in rows:
        fits = lambda x: None not in (x, k) and 1 <= x < k and (t, x) in have  # noqa: B023, E731
        before = [r[1] for r in rows if r[0] == t and r[2] == "decision" and k is not None and r[1] is not None and r[1] < k]
        got = (cause, "caused_by") if fits(cause) else (parent, "parent") if fits(parent) else (max(before), "decision") if before else (None, None)
        want.append((t, k, *got))
    ties = {(t, k) for t, k in have if sum(r[:2] == (t, k) for r in rows) > 1}  # the nearest decision may be one of the same number
    key = lambda r: tuple(str(x) for x in r)
    some = lambda x: sorted((tuple(r) for r in x if (r[0], r[1]) not in ties), key=key)
    assert some(graph.antecedents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == some(want)


def test_steps_without_gaps_are_not_joined(spark):
    steps = spark.createDataFrame([("a", i, "output", None, i - 1) for i in range(1, 9)], SCHEMA)
    out = graph.antecedents(steps)
    assert sorted(r.antecedent or 0 for r in out.collect()) == list(range(8))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Initial Plan")[0]  # what adaptive execution left of it


def test_walks_in_place_equal_walks_by_joins(spark):
    rnd = random.Random(9)
    rows = []
    for t in range(50):
        for n in rnd.sample(range(1, 40), rnd.randint(1, 25)):
            rows.append((f"t{t}", n, rnd.choice(["decision", "output"]), rnd.choice([None, *range(0, 40)]), rnd.choice([None, n - 1, n])))
    rows += [(f"long{n}", k, "output", k - 1, None) for n in (1, 2) for k in range(1, 60)] + [(None, 1, "decision", None, None), (None, 2, "output", 1, None), ("t0", None, "output", 1, None)]
    df = spark.createDataFrame(rows, "trace_id string, step_number int, step_type string, caused_by_step_number int, parent_step_number int").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        get = lambda whole: sorted(map(tuple, graph.causal_walk(df, None, whole).collect()), key=str)
        want = get(0)
        assert want == get(30) == get(10_000) and max(hop for _, hop, *_ in want) == 58
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
