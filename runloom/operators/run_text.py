"""Patterns sought in the texts of whole runs, which are not put together but for patterns without a bound."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from re import _constants as re_constants
from re import _parser as re_parser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running
from ..functions.workers import cut

WIDEST = 1_000  # characters of a match that stitches look for; a wider pattern takes the whole run
PLACES = 1 << 20  # places of a run that are stitched together
SECTION = 1 << 50  # places of a section of a run
MANY = 100_000  # places of a section, beyond which a run is long
BUT_WORDS = (re_constants.AT_BOUNDARY, re_constants.AT_NON_BOUNDARY)


@dataclass(frozen=True)
class Reach:
    """width: characters of the longest match, None without a bound. inner: what matches in a part of a run matches in the run."""

    width: int | None
    inner: bool


def reach(pattern: str) -> Reach:
    """How far a pattern sees. Anchors and lookarounds see all of a run; what can't be read here is taken to do so too."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return Reach(None, False)

    def sees_far(x) -> bool:
        if isinstance(x, tuple) and x:
            if x[0] is re_constants.AT:
                return x[1] not in BUT_WORDS
            if x[0] in (re_constants.ASSERT, re_constants.ASSERT_NOT):
                return True
        return isinstance(x, (tuple, list, re_parser.SubPattern)) and any(sees_far(y) for y in x)

    if sees_far(tree) or tree.state.flags & re.VERBOSE:
        return Reach(None, False)
    most = tree.getwidth()[1]
    return Reach(most if most <= WIDEST else None, True)


def stitched(pieces: DataFrame, width: int) -> DataFrame:
    """(trace_id, seam): around the end of each piece, what any match of at most width characters that crosses it needs, with one character more on both sides.

    pieces: (trace_id, place, text), place a whole number, different in each row of a run; texts stand in its order, a space apart. The first and last
    characters of a seam are no part of a match; before the first piece and after the last stands a line feed. Seams are made over blocks of PLACES
    characters, so that a long run is no one's task; a piece adds its ends only.
    """
    some = width + 1
    ends = pieces.select("trace_id", "place", F.length("text").alias("size"), F.left("text", F.lit(some)).alias("head"), F.right("text", F.lit(some)).alias("tail"))
    ends = ends.withColumn("head", F.concat(F.lit(" "), "head"))
    closing = ends.select("trace_id").distinct().select("trace_id", F.lit((1 << 62) - 1).alias("place"), F.lit(0).alias("size"), F.lit("\n").alias("head"), F.lit(None).cast("string").alias("tail"))
    rows = running(ends.union(closing), ["trace_id"], "place", {"after": F.col("size") + 1})
    stop = F.col("after") - 1
    start = stop - F.col("size")
    block = lambda at: F.floor(at / PLACES)
    lead = F.when(F.col("size") >= some, "").when(start == 0, "\n").otherwise(" ")  # of a longer piece the tail's own first character stands before
    tails = rows.where("tail is not null").select("trace_id", block(stop).alias("b"), stop.alias("at"), F.concat(lead, "tail").alias("tail"), F.lit(None).cast("string").alias("head"))
    heads = rows.select("trace_id", F.explode(F.array_distinct(F.array(block(start), block(start - width - 2)))).alias("b"), start.alias("at"), F.lit(None).cast("string").alias("tail"), "head")
    w = Window.partitionBy("trace_id", "b").orderBy("at").rangeBetween(1, width + 2)
    seams = tails.union(heads).withColumn("next", F.collect_list("head").over(w)).where("tail is not null")
    return seams.select("trace_id", F.concat("tail", F.array_join("next", "")).alias("seam"))


def _near(pieces: DataFrame, near: Mapping[str, Reach], patterns: Mapping[str, str]) -> DataFrame:
    """(trace_id, a boolean for each pattern, long): what pieces hold and, but for long runs, what seams between them hold, as stitched() makes them.

    A run is dealt and read in order once, with its pieces' ends only. Runs with places beyond MANY in a section of SECTION are long: they are
    dealt in parts, so that none is one task's, and their seams are not looked at.
    """
    short = [n for n in patterns if near[n].width]
    width = max((near[n].width for n in short), default=0)
    some, no, size = width + 1, F.lit(False), F.length("text")
    far = (F.col("place") < 0) | (F.col("place") >= 8 * SECTION) | (F.pmod(F.col("place"), F.lit(SECTION)) >= MANY)
    held = {f"in_{n}": F.coalesce(F.col("text").rlike(f"(?i){patterns[n]}"), no) for n in patterns if near[n].inner}
    rows = pieces.select("trace_id", "place", *(c.alias(n) for n, c in held.items()), *((size.alias("size"), F.left("text", F.lit(some)).alias("head"), F.right("text", F.lit(some)).alias("tail")) if short else ()))
    rows = rows.withColumn("part", F.when(far, F.floor(F.col("place") / MANY)).otherwise(-1).cast("bigint"))
    seam = {}
    if short:
        w = Window.partitionBy("trace_id", "part")
        by_place = w.orderBy("place")
        after = F.sum(F.col("size") + 1).over(by_place)
        rows = rows.withColumns({"stop": after - 1, "next": F.coalesce(F.concat(F.lit(" "), F.lead("head").over(by_place)), F.lit("\n"))}).drop("head", "place")
        start = F.when(F.col("size") >= some, "").when(F.col("stop") == F.col("size"), "\n").otherwise(" ")
        rows = rows.withColumn("nexts", F.collect_list("next").over(w.orderBy("stop").rangeBetween(0, some)))
        rows = rows.withColumn("seam", F.concat(start, "tail", F.array_join("nexts", "")))
        seam = {n: F.coalesce(F.col("seam").rlike(rf"(?<=[\s\S])(?i:{patterns[n]})(?=[\s\S])"), no) for n in short}
    per = rows.groupBy("trace_id").agg(
        *(F.max((F.col(f"in_{n}") if near[n].inner else no) | seam.get(n, no)).alias(n) for n in patterns), F.max(F.col("part") >= 0).alias("long"), F.max(F.col("part") < -1).alias("low"),
        *(F.max(F.col(f"in_{n}") if near[n].inner else no).alias(f"own_{n}") for n in patterns),
    )
    long = F.col("long") | F.col("low")
    return per.select("trace_id", *(F.when(long, F.col(f"own_{n}")).otherwise(F.col(n)).alias(n) for n in patterns), long.alias("long"))


def found(pieces: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(trace_id, a boolean for each pattern): whether it stands, letter case folded, anywhere in a run of pieces (trace_id, place, text); see stitched().

    Pieces and seams are searched as they lie. A pattern with anchors, lookarounds or no bound on its matches needs a run's whole text in a row; only runs
    in which no piece has it already are put together, and their texts must fit in a row.
    """
    near = {n: reach(p) for n, p in patterns.items()}
    out = cut(_near(pieces, near, patterns))
    long = out.where("long").select("trace_id")
    short = [n for n in patterns if near[n].width]
    wide = [n for n in patterns if near[n].width is None]
    many = bool(short) and not long.isEmpty()
    out = out.drop("long")
    if many:
        seams = stitched(pieces.join(long, "trace_id", "left_semi"), max(near[n].width for n in short))
        crossed = seams.groupBy("trace_id").agg(*(F.max(F.col("seam").rlike(rf"(?<=[\s\S])(?i:{patterns[n]})(?=[\s\S])")).alias(f"seam_{n}") for n in short))
        out = _either(out, crossed, short, "seam")
    if wide:
        open_ = out.where(" or ".join(f"not `{n}`" for n in wide)).select("trace_id")
        told = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
        runs = pieces.join(open_, "trace_id", "left_semi").groupBy("trace_id").agg(F.array_join(told, " ").alias("text"))
        out = _either(out, runs.select("trace_id", *(F.col("text").rlike(f"(?i){patterns[n]}").alias(f"run_{n}") for n in wide)), wide, "run")
        out = cut(out)  # a few booleans a run, so that the runs' texts are off the disk before what comes next
    return out


def _either(one: DataFrame, two: DataFrame, names: list[str], prefix: str) -> DataFrame:
    more = {n: F.col(n) | F.coalesce(f"{prefix}_{n}", F.lit(False)) for n in names}
    return one.join(two, "trace_id", "left").withColumns(more).select(*one.columns)


def run_pieces(traces: DataFrame, steps: DataFrame, produced: bool) -> DataFrame:
    """(trace_id, place, text) of runs: the trace's output and its steps' outputs in their order; unless produced, then its input, its error, and each
    step's name, input and error. What is absent is an empty JSON string. Steps without a step_number stand in the order of their rows."""
    text = lambda x: F.coalesce(x, F.lit('""'))
    listed = F.to_json(F.array(F.coalesce("error", F.lit(""))))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    number = F.col("step_number").cast("bigint") if "step_number" in steps.columns else F.monotonically_increasing_id()
    part = lambda section, x, n=None: F.struct((F.lit(section * SECTION) + (F.lit(0) if n is None else n)).alias("place"), x.alias("text"))
    own = [part(0, text(F.col("output")))] + ([] if produced else [part(2, text(F.col("input"))), part(3, quoted)])
    n = F.col("number")
    each = [part(1, text(F.col("output")), n)] + ([] if produced else [part(4, F.concat_ws(" ", "name", text(F.col("input")), quoted), n)])
    of_traces = traces.select(F.col("id").alias("trace_id"), F.inline(F.array(*own)))
    return of_traces.union(steps.withColumn("number", number).select("trace_id", F.inline(F.array(*each))))

