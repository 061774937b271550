"""Comparing traces: field-level diffs of pairs, and checks against golden baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import canonical, input_key
from ..functions.workers import cut

# Compared fields in their order.
STEP_FIELDS = ("step_type", "name", "input", "output", "model", "error", "decision")
TRACE_FIELDS = (("trace_input", "input"), ("status", "status"), ("trace_error", "error"), ("trace_output", "output"))
PAYLOADS = ("input", "output", "trace_input", "trace_output")
CHECK_FIELDS = ("step_count", "step_types", "step_names", "tool_inputs", "step_errors", "status", "model")
DEFAULT_FIELDS = CHECK_FIELDS[:-1]


def _cells(fields: Sequence[tuple[str, str]]) -> Column:
    """(field, left, right) of the fields whose texts differ between the structs l and r."""
    side = lambda tag, f: F.col(f"{tag}.{f}")
    one = lambda name, f: F.struct(F.lit(name).alias("field"), side("l", f).alias("left"), side("r", f).alias("right"))
    return F.array_compact(F.array(*(F.when(~side("l", f).eqNullSafe(side("r", f)), one(name, f)) for name, f in fields)))


def diff(
    traces: DataFrame, steps: DataFrame, pairs: DataFrame, fields: Sequence[str] | None = None, decisions: DataFrame | None = None
) -> DataFrame:
    """(pair_id, step_number, field, left, right) of every difference of pairs (pair_id, left_id, right_id).

    Steps pair up by number; a step on one side only gives missing_left or missing_right with its name. Payloads are compared as
    canonical JSON, decisions by what was chosen, why and by whom. Differences of the traces themselves have no step number.
    Fields narrow the result, but never hide missing steps. A pair's steps are read in one join and meet in one grouping.
    """
    known = {*STEP_FIELDS, *(n for n, _ in TRACE_FIELDS)}
    if fields is not None and (not fields or set(fields) - known):
        raise ValueError(f"fields must be some of {sorted(known)}")
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.col("left_id").alias("trace_id")), F.struct(F.lit(False).alias("left"), F.col("right_id").alias("trace_id"))
    )).alias("x")).select("pair_id", "x.*")
    # decisions are joined to the steps of pairs only, not to all that are there
    rows = steps.join(sides, "trace_id")
    if decisions is not None:
        made = F.to_json(F.struct("chosen", "rationale", "decided_by"), {"ignoreNullFields": "false"})
        rows = rows.join(decisions.select("trace_id", "step_number", made.alias("decision")), ["trace_id", "step_number"], "left")
    else:
        rows = rows.withColumn("decision", F.lit(None).cast("string"))
    rows = rows.select("pair_id", "left", "step_number", F.struct(*STEP_FIELDS).alias("s"))
    both = rows.groupBy("pair_id", "step_number").agg(
        F.max(F.when(F.col("left"), F.col("s"))).alias("l"), F.max(F.when(~F.col("left"), F.col("s"))).alias("r")
    )
    none = F.lit(None).cast("string")
    gone = lambda name, left, right: F.array(F.struct(F.lit(name).alias("field"), left.alias("left"), right.alias("right")))
    cells = (
        F.when(F.col("l").isNull(), gone("missing_left", none, F.col("r.name")))
        .when(F.col("r").isNull(), gone("missing_right", F.col("l.name"), none)).otherwise(_cells([(f, f) for f in STEP_FIELDS]))
    )
    inner = both.select("pair_id", "step_number", F.explode(cells).alias("x"))
    own = traces.select(F.col("id").alias("trace_id"), F.struct(*(f for _, f in TRACE_FIELDS)).alias("s")).join(sides, "trace_id")
    outer = own.groupBy("pair_id").agg(F.max(F.when(F.col("left"), F.col("s"))).alias("l"), F.max(F.when(~F.col("left"), F.col("s"))).alias("r"))
    outer = outer.where("l is not null and r is not null")
    outer = outer.select("pair_id", F.lit(None).cast("int").alias("step_number"), F.explode(_cells(TRACE_FIELDS)).alias("x"))
    out = inner.union(outer).select("pair_id", "step_number", "x.field", "x.left", "x.right")
    if fields is not None:
        out = out.where(F.col("field").isin(*fields) | F.col("field").startswith("missing_"))
    # only payloads whose texts differ are brought into canonical form
    payload = F.col("field").isin(*PAYLOADS)
    same = canonical(F.when(payload, F.col("left"))).eqNullSafe(canonical(F.when(payload, F.col("right"))))
    return out.withColumn("__same", same).where(~payload | ~F.col("__same")).drop("__same")


def divergence(differences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, differences, divergence_step): the first step that differs; differences of the traces alone never count for it."""
    n = differences.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("step_number").alias("divergence_step"))
    return pairs.join(n, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("differences"), "divergence_step")


def golden_steps(steps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(trace_id, ord, step_number, step_type, name, input, failed, model, and what is kept): steps in order; a tool call's input in canonical form."""
    w = Window.partitionBy("trace_id").orderBy("step_number")
    rows = steps.select("trace_id", F.row_number().over(w).alias("ord"), "step_number", "step_type", "name", "input", F.col("error").isNotNull().alias("failed"), "model", *keep)
    return rows.withColumn("input", canonical(F.when(F.col("step_type") == "tool_call", F.coalesce("input", F.lit("{}")))))


def golden_entries(traces: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, ord, agent_name, input_hash, status, n, sig, exercises...) of each trace, given golden_steps().

    ord orders the baselines: the traces' own column of that name, or else their id. An empty input has no key and matches nothing. Traces
    with equal sig have the same steps: two sums over the steps' hashes, so that no trace is gathered into one row.
    """
    one = F.xxhash64("ord", "step_type", "name", "input", "failed", "model")
    per = numbered.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(one, F.lit(7))).alias("s2"),
        F.max((F.col("step_type") == "tool_call") & F.col("input").isNotNull()).alias("tools"),
        F.max(F.col("failed").isNotNull()).alias("errors"), F.max(F.col("model").isNotNull()).alias("models"),
    )
    rows = traces.join(per, F.col("id") == F.col("trace_id"), "left")
    order = F.col("ord") if "ord" in traces.columns else F.col("id")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select(
        "id", order.alias("ord"), "agent_name", input_key(canonical(F.col("input"))).alias("input_hash"), "status",
        F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.struct("s1", "s2", "n", "status").alias("sig"), no("tools"), no("errors"), no("models"),
    )


def comparable(traces: DataFrame, ids: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """(candidates, how many were left out): forks and running traces are left out unless named."""
    if ids is not None:
        return traces.where(F.col("id").isin(*ids)), 0
    good = F.col("parent_trace_id").isNull() & (F.col("status") != "running")
    return traces.where(good), traces.where(~F.coalesce(good, F.lit(False))).count()


def _fields(fields: Sequence[str] | None) -> Sequence[str]:
    if fields is not None and (not fields or set(fields) - set(CHECK_FIELDS)):
        raise ValueError(f"fields must be some of {CHECK_FIELDS}")
    return DEFAULT_FIELDS if fields is None else fields


def check_golden(
    golden: DataFrame, golden_rows: DataFrame, candidates: DataFrame, rows: DataFrame, fields: Sequence[str] | None = None, strict: bool = False
) -> DataFrame:
    """(candidate_id, golden_id, divergences, at, exact, passed): each candidate against the entry of its key that it diverges from least.

    golden and candidates: golden_entries(); golden_rows and rows: golden_steps(). Divergences are fields, at the numbers of the candidate's first
    steps that differ in them (0 for the whole trace), exact the ord of the first entry that is reproduced. A candidate passes where it
    reproduces any entry of its key; without an entry it passes unless strict. Of equal traces of a key one stands for all, on both sides.
    """
    fields = _fields(fields)
    key = ["agent_name", "input_hash"]
    first = lambda x, rep: x.where("input_hash is not null").groupBy(*key, "sig").agg(F.min(F.struct("ord", "id")).alias(rep))
    g = first(golden, "g").select(*key, F.col("g.ord").alias("g_ord"), F.col("g.id").alias("gid"), F.col("sig.n").alias("gn"), F.col("sig.status").alias("gs"))
    c = first(candidates, "c").select(*key, F.col("sig").alias("csig"), F.col("c.id").alias("cid"), F.col("sig.n").alias("cn"), F.col("sig.status").alias("cs"))
    pairs = c.join(g, key)
    tell = ("step_type", "name", "input", "failed", "model")
    left = golden_rows.select(F.col("trace_id").alias("gid"), "ord", F.struct(*tell).alias("g"))
    right = rows.select(F.col("trace_id").alias("cid"), "ord", "step_number", F.struct(*tell).alias("c"))
    met = pairs.select("cid", "gid").join(left, "gid").join(right, ["cid", "ord"])
    tool = (F.col("g.step_type") == "tool_call") & F.col("g.input").isNotNull()
    differs = {
        "step_types": F.col("g.step_type") != F.col("c.step_type"),
        "step_names": F.col("g.name") != F.col("c.name"),
        "tool_inputs": tool & ((F.col("c.step_type") != "tool_call") | ~F.col("g.input").eqNullSafe(F.col("c.input"))),
        "step_errors": ~F.col("g.failed") & F.col("c.failed"),
        "model": F.col("g.model").isNotNull() & ~F.col("g.model").eqNullSafe(F.col("c.model")),
    }
    worst = met.groupBy("cid", "gid").agg(*(F.min_by("step_number", F.when(x, F.col("ord"))).alias(f) for f, x in differs.items()))
    n = lambda x: F.coalesce(x, F.lit(0))
    whole = {"step_count": F.when(n(F.col("gn")) != n(F.col("cn")), 0), "status": F.when(F.col("gs") != F.col("cs"), 0)}
    place = {f: whole.get(f, F.col(f)).cast("int") for f in CHECK_FIELDS}
    found = F.array_compact(F.array(*(F.when(place[f].isNotNull(), F.struct(F.lit(f).alias("f"), place[f].alias("at"))) for f in CHECK_FIELDS if f in fields)))
    tested = pairs.join(worst, ["cid", "gid"], "left").withColumn("found", found)
    shapes = tested.groupBy(*key, "csig").agg(
        F.min_by(F.struct("gid", "found"), F.struct(F.size("found"), "g_ord")).alias("best"), F.min(F.when(F.size("found") == 0, F.col("g_ord"))).alias("exact")
    )
    named = candidates.select(F.col("id").alias("candidate_id"), *key, F.col("sig").alias("csig"))
    same = [named[k] == shapes[k] for k in key] + [named["csig"].eqNullSafe(shapes["csig"])]
    out = named.join(shapes, same[0] & same[1] & same[2], "left")
    join = lambda part: F.array_join(F.transform("best.found", lambda x: x[part].cast("string")), ",")
    passed = F.when(F.col("best").isNull(), not strict).otherwise(F.size("best.found") == 0)
    return out.select(
        "candidate_id", F.col("best.gid").alias("golden_id"), join("f").alias("divergences"), join("at").alias("at"), "exact", passed.alias("passed")
    )


def golden_report(
    checked: DataFrame, golden: DataFrame, candidates: DataFrame, fields: Sequence[str] | None = None, strict: bool = False
) -> DataFrame:
    """One row: passed, failed, unmatched, uncovered (entries that no candidate met), uncompared (named fields that the entries used
    for some candidate can't exercise, where nothing failed) and ok."""
    key = ["agent_name", "input_hash"]
    checked = cut(checked)  # read twice
    seen = candidates.where("input_hash is not null").select(*key).distinct()
    uncovered = golden.join(seen, key, "left_anti").agg(F.count("*").alias("uncovered"))
    total = checked.agg(
        F.count_if(F.col("passed") & F.col("golden_id").isNotNull()).alias("passed"),
        F.count_if(~F.col("passed") & F.col("golden_id").isNotNull()).alias("failed"), F.count_if(F.col("golden_id").isNull()).alias("unmatched"),
    )
    exercises = {
        "step_count": F.lit(True), "step_types": F.col("n") > 0, "step_names": F.col("n") > 0, "tool_inputs": F.col("tools"),
        "step_errors": F.col("errors"), "status": F.col("status").isNotNull(), "model": F.col("models"),
    }
    asked = [] if fields is None else list(_fields(fields))
    # entries are used in their order up to the one that is reproduced, so the first that exercises a field tells
    firsts = golden.where("input_hash is not null").groupBy(*key).agg(F.count("*"), *(F.min(F.when(exercises[f], F.col("ord"))).alias(f) for f in asked))
    used = checked.where("golden_id is not null").join(candidates.select(F.col("id").alias("candidate_id"), *key), "candidate_id").join(firsts, key)
    blank = used.agg(F.count("*"), *(F.coalesce(F.max(F.col(f).isNull() | (F.col(f) > F.col("exact"))), F.lit(False)).alias(f) for f in asked))
    blank = blank.select(F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(f), F.lit(f)) for f in asked))), ",").alias("blank"))
    rows = total.crossJoin(F.broadcast(uncovered)).crossJoin(F.broadcast(blank))  # one row beside one row
    rows = rows.withColumn("uncompared", F.when((F.col("failed") == 0) & (F.col("passed") > 0), F.col("blank")).otherwise(""))
    fine = (F.col("failed") == 0) & (F.col("uncompared") == "")
    if strict:
        fine &= (F.col("unmatched") == 0) & (F.col("uncovered") == 0)
    return rows.select("passed", "failed", "unmatched", "uncovered", "uncompared", fine.alias("ok"))


def refuse(golden: DataFrame, candidates: DataFrame, checked: DataFrame, strict: bool = False, allow_empty: bool = False) -> None:
    """ValueError where a check would say nothing: an empty baseline, no candidates, or none that meets an entry."""
    if golden.isEmpty():
        raise ValueError("the baseline holds no entries")
    if candidates.isEmpty() and not allow_empty:
        raise ValueError("there is no trace to check")
    if not strict and not allow_empty and checked.where("golden_id is not null").isEmpty():
        raise ValueError("no trace meets an entry of the baseline")
