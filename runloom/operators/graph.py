"""Step graphs: decisions, causes, trees, forks and step order, over all traces at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsons import merged
from ..functions.workers import cut, ready

HOPS = 8  # steps of a causal chain that are followed in one job
WHOLE = 10_000  # steps of a trace up to which it is walked in place


def decision_points(steps: DataFrame) -> DataFrame:
    return steps.where("step_type = 'decision'")


def prior_decision(steps: DataFrame) -> DataFrame:
    """steps with the nearest earlier decision's number (an as-of join within the trace)."""
    w = Window.partitionBy("trace_id").orderBy("step_number").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("step_type") == "decision", F.col("step_number"))
    return steps.withColumn("prior_decision", F.last(n, ignorenulls=True).over(w))


def drop_forward_refs(steps: DataFrame) -> DataFrame:
    """References to the step itself or a later one become null."""
    keep = lambda c: F.when((F.col(c) >= 1) & (F.col(c) < F.col("step_number")), F.col(c)).alias(c)
    refs = ("parent_step_number", "caused_by_step_number")
    return steps.select(*(keep(c) if c in refs else F.col(c) for c in steps.columns))


def antecedents(steps: DataFrame) -> DataFrame:
    """(trace_id, step_number, antecedent, link): the cause where it exists, else the parent, else the nearest earlier decision.

    A trace is dealt and sorted once. Where no number between the first of a trace and a step's own is missing, what it refers to exists unless it is before the
    first; only steps behind a gap are joined with the steps of their traces.
    """
    refs = {"__cause": "caused_by_step_number", "__parent": "parent_step_number"}
    w = Window.partitionBy("trace_id").orderBy("step_number")
    number = F.col("step_number").cast("bigint")
    first = F.min(number).over(w)
    place = F.dense_rank().over(w) - F.max(number.isNull().cast("int")).over(w)  # steps without a number come first and count for one
    rows = prior_decision(drop_forward_refs(steps)).withColumns({"__first": first, "__whole": F.coalesce(number - first == place - 1, F.lit(False))})
    there = lambda ref: F.when(~F.col("__whole") | (F.col(ref) >= F.col("__first")), F.col(ref)).alias(ref)
    rows = cut(rows.select("trace_id", "step_number", *(there(ref) for ref in refs.values()), "prior_decision", "__whole"))
    near = rows.where("__whole").withColumns({flag: F.col(ref).isNotNull() for flag, ref in refs.items()})
    far = rows.where("not __whole")
    have = rows.join(far.select("trace_id").distinct(), "trace_id", "left_semi").select("trace_id", "step_number").distinct()
    for flag, ref in refs.items():
        there = have.select("trace_id", F.col("step_number").alias(ref), F.lit(True).alias(flag))
        far = far.join(there, ["trace_id", ref], "left")
    rows = near.unionByName(far)
    cause, parent = F.col("__cause"), F.col("__parent")
    number = F.when(cause, F.col("caused_by_step_number")).when(parent, F.col("parent_step_number")).otherwise(F.col("prior_decision"))
    link = F.when(cause, "caused_by").when(parent, "parent").when(F.col("prior_decision").isNotNull(), "decision")
    return rows.select("trace_id", "step_number", number.alias("antecedent"), link.alias("link"))


def in_place(rows: DataFrame, first: list[Column], walk: Callable[[list, list], tuple[list, ...]], made: tuple[str, ...], most: int) -> DataFrame:
    """rows (trace_id, n, to and more), of those of an n the first, with the whole numbers that walk makes of the n and to of a trace, in order of n; null in
    traces of more than ``most`` rows.

    Spark deals and sorts the traces once; a task reads them one after another and holds a batch and ``most`` rows at the most.
    """
    ready()
    schema = T.StructType([*rows.schema, *(T.StructField(name, T.IntegerType()) for name in made)])
    w = Window.partitionBy("trace_id").orderBy("n", *first)
    rows = rows.withColumns({"__place": F.row_number().over(w), "__before": F.lag("n").over(w)})
    rows = rows.where(~F.col("n").eqNullSafe(F.col("__before")) | (F.col("__place") == 1)).drop("__before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of a trace that may go on
        for batch in chain(batches, [None]):
            parts = held if batch is None else [*held, pa.Table.from_batches([batch])]
            if not parts:
                continue
            table = pa.concat_tables(parts).combine_chunks()
            starts = np.flatnonzero(table["__place"].to_numpy() == 1).tolist()
            size, last = len(table), starts[-1] if starts else 0
            end = size if batch is None or size - last > most else last  # a trace that is too long is given out as it comes
            held = [table.slice(end)] if end < size else []
            done = table.slice(0, end)
            n, to = done["n"].to_pylist(), done["to"].to_pylist()
            out: list[list] = [[None] * end for _ in made]
            starts = [a for a in starts if a < end]
            for a, b in zip(starts, [*starts[1:], end]):
                if b - a <= most:
                    for column, values in zip(out, walk(n[a:b], to[a:b])):
                        column[a:b] = values
            done = done.drop_columns("__place")
            for name, values in zip(made, out):
                done = done.append_column(name, pa.array(values, pa.int32()))
            yield from done.to_batches()

    return rows.mapInArrow(run, schema)


def hops(n: list, to: list) -> tuple[list]:
    """How many references lead from the last step to each; -1 where none do."""
    at, out, i, hop = {x: i for i, x in enumerate(n)}, [-1] * len(n), len(n) - 1, 0
    while i is not None and out[i] < 0:
        out[i], hop = hop, hop + 1
        i = at.get(to[i])
    return (out,)


def pre_order(n: list, up: list) -> tuple[list, list]:
    """Depth and position of each step of a tree; what no root reaches begins anew at the smallest step that is left."""
    at, below, roots = {x: i for i, x in enumerate(n)}, {}, []
    for i, x in enumerate(up):
        above = None if x is None else at.get(x)
        if above is None or above == i:
            roots.append(i)
        else:
            below.setdefault(above, []).append(i)
    depth, position, seen = [None] * len(n), [None] * len(n), 0
    for root in chain(roots, range(len(n))):
        todo = [(root, 0)] if position[root] is None else []
        while todo:
            i, d = todo.pop()
            if position[i] is None:
                depth[i], position[i], seen = d, seen, seen + 1
                todo += [(j, d + 1) for j in reversed(below.get(i, ()))]
    return depth, position


def causal_walk(steps: DataFrame, start: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """(trace_id, hop, step_number, link) from each trace's last step, or from start (trace_id, step_number), back to the first cause.

    References point strictly backwards. Traces of at most ``whole`` steps are dealt and sorted once and walked in place; longer ones, and those with a start, by joins. The first ``HOPS`` steps of every chain are joined on in one job, which shuffles the references once. Where chains are longer, the
    pointers of their traces only are doubled: after r rounds of equi-joins the chains hold their next 2**r steps, so the rounds grow with the logarithm
    of the longest chain and no trace is gathered into one row.
    """
    if start is not None:
        own = F.max(F.struct("antecedent", "link")).alias("x")
        return _joined_walk(cut(antecedents(steps).groupBy("trace_id", "step_number").agg(own).select("trace_id", "step_number", "x.*")), start)
    rows = antecedents(steps).where("trace_id is not null and step_number is not null").select("trace_id", F.col("step_number").alias("n"), F.col("antecedent").alias("to"), "link")
    rows = cut(in_place(rows, [F.desc("to"), F.desc("link")], hops, ("hop",), whole).where("hop is null or hop >= 0").withColumnRenamed("n", "step_number"))
    near = rows.where("hop is not null").select("trace_id", "hop", "step_number", "link")
    far = rows.where("hop is null").select("trace_id", "step_number", F.col("to").alias("antecedent"), "link")
    return near if far.isEmpty() else near.unionByName(_joined_walk(far, far.groupBy("trace_id").agg(F.max("step_number").alias("step_number"))))


def _joined_walk(ante: DataFrame, start: DataFrame) -> DataFrame:
    walk = start.select("trace_id", F.col("step_number").alias("s0"))
    for k in range(HOPS):
        walk = walk.join(ante.select("trace_id", F.col("step_number").alias(f"s{k}"), F.col("antecedent").alias(f"s{k + 1}")), ["trace_id", f"s{k}"], "left")
    walk = cut(walk)
    reached = walk.select("trace_id", F.posexplode(F.array(*(f"s{k}" for k in range(HOPS)))).alias("hop", "step_number")).where("step_number is not null")
    new = walk.where(f"s{HOPS} is not null").select("trace_id", F.col(f"s{HOPS}").alias("step_number"), F.lit(HOPS).alias("hop"))
    if not new.isEmpty():
        jump = ante.where("antecedent is not null").join(new.select("trace_id").distinct(), "trace_id", "left_semi").select("trace_id", "step_number", F.col("antecedent").alias("to"))
        further, size = new, 1  # each jump leads over so many steps
        while True:
            new = further.join(jump, ["trace_id", "step_number"])
            new = cut(new.select("trace_id", F.col("to").alias("step_number"), (F.col("hop") + size).alias("hop")))
            if new.isEmpty():
                break
            further = further.union(new)
            on = jump.select("trace_id", F.col("step_number").alias("to"), F.col("to").alias("__to"))
            jump = cut(jump.join(on, ["trace_id", "to"]).select("trace_id", "step_number", F.col("__to").alias("to")))
            size *= 2
        reached = reached.unionByName(further)
    return reached.join(ante, ["trace_id", "step_number"]).select("trace_id", "hop", "step_number", "link")


def step_tree(steps: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(trace_id, step_number, depth, position): pre-order of each trace's parent tree. Every step comes once; steps whose parent is missing are roots. In a
    cycle, and beneath one, a step that is smaller than all above it is a root, so each cycle is cut at its smallest step; these roots come last.

    Traces of at most ``whole`` steps are dealt and sorted once and walked in place. Longer ones are treed set-wise, so that one of any size or depth is spread over the cluster: pointers to the 1st, 2nd, 4th ... step above are made by doubling; sizes of branches are summed up along
    them; a step's place among its siblings is the sizes of the earlier ones, and its position the sum of places on its way to the root, again by doubling. The
    rounds of equi-joins grow with the logarithm of the deepest chain.
    """
    up = F.expr("case when trace_id is not null and step_number is not null then cast(parent_step_number as int) end")  # steps without a trace or a number are roots
    rows = steps.select("trace_id", F.col("step_number").cast("int").alias("n"), up.alias("to"))
    rows = cut(in_place(rows, [F.asc_nulls_last("to")], pre_order, ("depth", "position"), whole))
    near = rows.where("depth is not null").select("trace_id", F.col("n").alias("step_number"), "depth", "position")
    far = rows.where("depth is null").select("trace_id", "n", F.col("to").alias("up"))
    return near if far.isEmpty() else near.unionByName(_joined_tree(far))


def _joined_tree(nodes: DataFrame) -> DataFrame:
    have = nodes.select("trace_id", F.col("n").alias("up"))
    edges = cut(nodes.where("up is not null and up <> n").join(have, ["trace_id", "up"], "left_semi").select("trace_id", "n", "up"))
    most = nodes.groupBy("trace_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0

    def jumps(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
        """(trace_id, n, to) for 1, 2, 4 ... steps up, and (trace_id, n, least) of the steps that never come to a root, least being the smallest above."""
        level, levels, length = edges.select("trace_id", "n", F.col("up").alias("to"), F.col("up").alias("least")), [], 1
        while not level.isEmpty():
            if length > most:  # as far as no tree is high: these run in circles
                return levels, level.select("trace_id", "n", "least")
            levels.append(level.select("trace_id", "n", "to"))
            on = level.select("trace_id", F.col("n").alias("to"), F.col("to").alias("__to"), F.col("least").alias("__least"))
            level = cut(level.join(on, ["trace_id", "to"]).select("trace_id", "n", F.col("__to").alias("to"), F.least("least", "__least").alias("least")))
            length *= 2
        return levels, None

    levels, circling = jumps(edges)
    late = nodes.select("trace_id", "n").limit(0)
    if circling is not None:
        late = cut(circling.where("n <= least").select("trace_id", "n"))
        edges = cut(edges.join(late, ["trace_id", "n"], "left_anti"))
        levels, _ = jumps(edges)
    size = nodes.select("trace_id", "n", F.lit(1).cast("bigint").alias("size"))
    for level in levels:
        more = size.join(level, ["trace_id", "n"]).groupBy("trace_id", F.col("to").alias("n")).agg(F.sum("size").alias("__more"))
        size = cut(size.join(more, ["trace_id", "n"], "left").select("trace_id", "n", (F.col("size") + F.coalesce("__more", F.lit(0))).alias("size")))
    rows = size.join(edges, ["trace_id", "n"], "left").join(late.withColumn("late", F.lit(True)), ["trace_id", "n"], "left")
    before = Window.partitionBy("trace_id", "up").orderBy(F.coalesce("late", F.lit(False)), "n").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.when(F.col("up").isNotNull(), 1).otherwise(0)
    place = cut(rows.select("trace_id", "n", inner.alias("depth"), (F.coalesce(F.sum("size").over(before), F.lit(0)) + inner).alias("position")))
    for level in levels:
        above = place.select("trace_id", F.col("n").alias("to"), F.col("depth").alias("__depth"), F.col("position").alias("__position"))
        found = level.join(above, ["trace_id", "to"]).drop("to")
        added = lambda c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
        place = cut(place.join(found, ["trace_id", "n"], "left").select("trace_id", "n", added("depth"), added("position")))
    return place.select("trace_id", F.col("n").alias("step_number"), F.col("depth").cast("int").alias("depth"), F.col("position").cast("int").alias("position"))


def fork(traces: DataFrame, steps: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Copies of the traces that have a step ``at``, running, with their steps up to it and new deterministic ids."""
    has = steps.where(F.col("step_number") == at).select(F.col("trace_id").alias("id"))
    new = lambda c: F.concat(F.lit("trc_"), F.substring(F.sha2(F.concat_ws("/", c, F.lit(str(at))), 256), 1, 12))
    chosen = traces.join(has, "id", "left_semi")
    forks = chosen.withColumns(
        {"parent_trace_id": F.col("id"), "id": new(F.col("id")), "status": F.lit("running"), "forked_from_step": F.lit(at)}
    )
    copied = steps.where(F.col("step_number") <= at).join(has.withColumnRenamed("id", "trace_id"), "trace_id", "left_semi")
    return forks, copied.withColumn("trace_id", new(F.col("trace_id")))


def forks(
    tables: dict[str, DataFrame], points: DataFrame, started_at: str, salt: str = "", input: str | None = None, context: str | None = None, tag: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Whole forks of traces at points (id, at): traces, steps, decisions and snapshots of the copies, and faults (id, at, message) of points that are no steps.

    A copy runs, has an id of its own, made of salt, id and point, and keeps the tags, session and metadata of its original, with forked_from and forked_at_step on top of these. input takes the
    place of its input, context that of the context window at the fork point, where a snapshot is made if there was none; tag is one more tag.
    """
    key = ["trace_id", "step_number"]
    new = F.concat(F.lit("trc_"), F.substring(F.sha2(F.concat_ws("/", F.lit(salt), "id", F.col("at").cast("string")), 256), 1, 16))
    asked = points.select("id", F.col("at").cast("int").alias("at")).distinct()
    there = tables["steps"].select(F.col("trace_id").alias("id"), F.col("step_number").alias("at")).distinct()
    have = cut(asked.join(tables["traces"].select("id"), "id", "left_semi").join(there, ["id", "at"], "left_semi").withColumn("new", new))
    stepped = there.select("id").distinct().withColumn("__some", F.lit(True))
    lost = asked.join(have, ["id", "at"], "left_anti").join(stepped, "id", "left")
    faults = lost.select("id", "at", F.when(F.col("__some"), "no such step to fork at").otherwise("no such trace, or one without steps").alias("message"))

    own = tables["traces"]
    meta = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("metadata")).startswith("OBJECT"), F.lit(False)), F.col("metadata")).otherwise("{}")
    proof = F.to_json(F.struct(F.col("id").alias("forked_from"), F.col("at").alias("forked_at_step")))
    gone = ("output", "ended_at", "total_duration_ms", "total_tokens", "total_cost_usd", "error")
    values = {c: F.lit(None).cast(own.schema[c].dataType) for c in gone if c in own.columns} | {
        "parent_trace_id": F.col("id"), "id": F.col("new"), "status": F.lit("running"), "started_at": F.lit(started_at), "trigger": F.lit("manual"), "forked_from_step": F.col("at"),
        "metadata": F.to_json(merged(meta, proof)),
    }
    values |= {"input": F.lit(input)} if input is not None else {}
    values |= {"tags": F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag)))} if tag is not None else {}
    copied = own.join(have, "id")
    traces = copied.select(*(values[c].alias(c) if c in values else F.col(c) for c in dict.fromkeys((*own.columns, "forked_from_step", "parent_trace_id"))))

    def upto(df: DataFrame) -> DataFrame:
        rows = df.join(have.withColumnRenamed("id", "trace_id"), "trace_id").where("step_number <= at")
        return rows.select(*(F.col("new").alias("trace_id") if c == "trace_id" else F.col(c) for c in df.columns))

    snapshots = upto(tables["snapshots"])
    if context is not None:
        at = have.select(F.col("new").alias("trace_id"), F.col("at").alias("step_number"), F.lit(True).alias("__put"))
        both = snapshots.join(at, key, "full_outer")
        blank = {"context_window": "[]", "environment": "{}", "tool_state": "{}", "token_count": 0}
        put = lambda c: F.when(F.col("__put"), F.lit(context)).otherwise(F.col(c)) if c == "context_window" else F.coalesce(F.col(c), F.lit(blank[c])) if c in blank else F.col(c)
        snapshots = both.select(*(put(c).alias(c) for c in tables["snapshots"].columns))
    return {"traces": traces, "steps": upto(tables["steps"]), "decisions": upto(tables["decisions"]), "snapshots": snapshots}, faults
