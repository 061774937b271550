import random

from pyspark.sql import functions as F

from runloom.operators import summary


def test_steps_are_fitted_greedily(spark):
    rnd = random.Random(1)
    steps = [("t", n, rnd.choice(["output", "tool_call", "thought"]), "s" * rnd.randint(1, 60), None, "bad" if n in (5, 17) else None) for n in range(1, 60)]
    df = spark.createDataFrame(steps, "trace_id string, step_number int, step_type string, name string, output string, error string")
    traces = spark.createDataFrame([("t", "a", "failed", "{}", None, "oh", "x", 59, 7), ("u", "b", "running", "{}", "1", None, "y", 0, None)],
                                   "id string, agent_name string, status string, input string, output string, error string, tag string, step_count int, effective_tokens int")
    got = {r.trace_id: r for r in summary.summarize(traces, df, 300).collect()}
    head = "TRACE: a [FAILED]\nINPUT: {}\n\nSTEPS (59 total, 7 tokens):"
    line = {n: f"#{n} [{kind}] {name}" + (f" ERROR {e}" if e else "") for _, n, kind, name, _, e in steps}
    rank = {n: 0 if n == 17 else 1 if e or kind == "output" else 2 for _, n, kind, _, _, e in steps}
    room, used, kept = 300 * 4 - 200 - len(head), 0, []
    for n in sorted(line, key=lambda n: (rank[n], n)):
        if used + len(line[n]) + 1 <= room:
            used, kept = used + len(line[n]) + 1, [*kept, n]
    want = "\n".join([head, *(line[n] for n in sorted(kept)), f"... ({59 - len(kept)} more steps omitted)", "\nERROR: oh\nTAGS: x"])
    assert got["t"].text == want and (got["t"].shown, got["t"].omitted) == (len(kept), 59 - len(kept)) and len(want) <= 1200
    assert got["u"].text == "TRACE: b [RUNNING]\nINPUT: {}\nOUTPUT: 1\n\nSTEPS (0 total):\nTAGS: y" and got["u"].tokens == -(-len(got["u"].text) // 4)


def test_diff_is_shown_where_it_parts(spark):
    left, right = "x" * 300 + "LEFT" + "y" * 300, "x" * 300 + "RIGHT" + "y" * 300
    rows = [("p", None, "status", "a", "b"), ("p", 2, "output", left, right)] + [("p", n, "name", "a", None) for n in range(3, 30)]
    got = summary.summarize_diff(spark.createDataFrame(rows, "pair_id string, step_number int, field string, left string, right string")).first()
    first = got.text.split("\n")[0]
    assert (got.listed, got.more) == (15, 14) and first.startswith("- Step 2, output: LEFT=...") and "LEFTyy" in first and "RIGHTyy" in first
    assert "RIGHT=(missing)" in got.text and max(map(len, got.text.split("\n"))) < 220


def test_cost(spark):
    one = spark.range(1)
    price = lambda *a: one.select(summary.cost(F.lit(680), *a)).first()[0]
    assert abs(price("small", 100) - (1000 * 0.25 + 100 * 1.25) / 1e6) < 1e-12
    assert price("no such model", 100) == price("large", 100) and price("small", 100, F.lit(False)) == 0.0
