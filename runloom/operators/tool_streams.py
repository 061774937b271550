"""Streams of tool_use and tool_result lines: calls paired with their results set-wise, steps, traces and the results that no call takes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.running import BLOCK, running
from ..functions.workers import cut, ready
from .hooks import failure_text, trueish

PAIR = "stream string, open_n long, close_n long"


def _calls(lines: DataFrame) -> DataFrame:
    """(stream, n, use, call, name) of the lines that open or close a call. An empty id is none; a call without a name is named tool."""
    v = F.col("v")
    use = V.text(v, "$.type") == "tool_use"
    rows = lines.select("stream", "n", V.parsed(F.col("line")).alias("v")).where(V.text(v, "$.type").isin("tool_use", "tool_result"))
    call, name = F.coalesce(V.text(v, "$.id"), V.text(v, "$.tool_use_id")), V.text(v, "$.name")
    return rows.select("stream", "n", use.alias("use"), F.nullif(call, F.lit("")).alias("call"), F.when(use, F.coalesce(name, F.lit("tool"))).otherwise(name).alias("name"))


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of rows sorted by (stream, n), one after the other. Only a stream's open calls are held."""
    stream = None
    names: dict[int, str] = {}  # open calls, the oldest first
    queues: dict[str, dict[int, None]] = {}
    ids: dict[str, int] = {}
    for frame in frames:
        out = []
        for s, n, use, call, name in zip(frame["stream"], frame["n"], frame["use"], frame["call"], frame["name"], strict=True):
            if s != stream:
                stream, names, queues, ids = s, {}, {}, {}
            if use:
                names[n] = name
                queues.setdefault(name, {})[n] = None
                if call is not None:
                    ids[call] = n
                continue
            at = ids.pop(call, None) if call is not None else None
            if at not in names:
                at = next(iter(names if name is None else queues.get(name, ())), None)
            if at is not None:
                out.append((s, at, n))
                del queues[names[at]][at]
                del names[at]
        yield pd.DataFrame(out, columns=["stream", "open_n", "close_n"]).astype({"stream": object, "open_n": "int64", "close_n": "int64"})


def _read(rows: DataFrame, odd: DataFrame) -> DataFrame:
    """Pairs of the streams (stream) of odd among the rows of _calls(), read line by line."""
    # cut, since a repartition right behind the join is planned away, and the join may then deal a stream's rows to several tasks
    narrow = cut(rows.join(odd, "stream", "left_semi").select("stream", "n", "use", "call", "name"))
    return narrow.repartition("stream").sortWithinPartitions("stream", "n").mapInPandas(_in_order, PAIR)


def pairs(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream, open_n, close_n) of lines (stream, n, line), n different in each line of a stream.

    A result closes the call last opened with its id, if that is open; else the oldest open call of its name; else, where it has no name, the oldest open call of all.
    It closes none where its name fits none.

    All streams are paired at once. A result whose id was used by a call and closed by no result since takes that call. What is left takes the calls that no id
    takes, first in, first out, by running counts: by name in streams whose other results all have names, over all calls where none has. This is what
    happens line by line, unless such a result meets an open call that is older than its own and that an id takes only later. Streams in which that
    occurs, or in which results with and without names are left, are read line by line in order, as narrow sorted rows, holding their open calls.
    """
    ready()
    rows = cut(_calls(lines).where("stream is not null"))
    with_id = running(rows.where("call is not null"), ("stream", "call"), "n", {"ends": F.when(F.col("use"), 0).otherwise(1)}, block=block)
    with_id = running(cut(with_id), ("stream", "call"), "n", tops={"last": F.when(F.col("use"), F.struct("n", "ends"))}, block=block)
    by_id = cut(with_id.where("not use and ends = last.ends + 1").select("stream", F.col("last.n").alias("open_n"), F.col("n").alias("close_n")))

    taken = by_id.select("stream", F.col("open_n").alias("n"), F.col("close_n").alias("other")).union(by_id.select("stream", "close_n", "open_n"))
    rows = rows.join(taken, ["stream", "n"], "left")
    left = rows.where("not use and other is null").groupBy("stream").agg(F.max(F.col("name").isNull()).alias("bare"), F.max(F.col("name").isNotNull()).alias("named"))
    rows = cut(rows.join(left, "stream"))
    queue = rows.where("not (bare and named) and (use or other is null)").withColumn("q", F.when(F.col("bare"), "").otherwise(F.col("name")))
    free = F.when(F.col("use") & F.col("other").isNull(), 1).otherwise(0)
    queue = cut(running(queue, ("stream", "q"), "n", {"opened": free, "closed": F.when(F.col("use"), 0).otherwise(1)}, block=block))
    queue = running(queue, ("stream", "q"), "n", tops={"void": F.col("closed") - F.col("opened"), "shut": F.when(F.col("use"), F.col("other"))}, block=block)
    excess, void = F.col("closed") - F.col("opened"), F.greatest("void", F.lit(0))
    queue = cut(queue.select("stream", "q", "n", "use", "other", "opened", "closed", "shut", (~F.col("use") & (excess > void)).alias("lost"), F.greatest(void, excess).alias("void")))
    opens = queue.where("use and other is null").select("stream", "q", F.col("opened").alias("nth"), F.col("n").alias("open_n"), "shut")
    closes = queue.where("not use and not lost").select("stream", "q", (F.col("closed") - F.col("void")).alias("nth"), F.col("n").alias("close_n"))
    met = cut(opens.join(closes, ["stream", "q", "nth"]).select("stream", "open_n", "close_n", "shut"))

    odd = met.where("shut > close_n").select("stream").union(queue.where("lost and shut > n").select("stream")).union(left.where("bare and named").select("stream"))
    odd = cut(odd.distinct())
    return by_id.union(met.drop("shut")).join(odd, "stream", "left_anti").union(_read(rows, odd))


def _text_of(v: Column, path: str) -> Column:
    """A string, or the texts of an array of strings and {text}, a line each."""
    parts = F.transform(V.items(v, path), lambda b: F.coalesce(V.text(b), V.text(b, "$.text"), F.lit("")))
    return F.coalesce(V.text(v, path), F.array_join(F.filter(parts, lambda x: x != ""), "\n"), F.lit(""))


def _count(v: Column, *paths: str) -> Column:
    """The first of some numbers, or numbers in texts, that is above 0."""
    read = (F.coalesce(V.number(v, p), V.text(v, p).try_cast("double")) for p in paths)
    return F.coalesce(*(F.when((x > 0) & (x < float("inf")), x) for x in read), F.lit(0.0))


def tool_stream(lines: DataFrame, block: int = BLOCK) -> dict[str, DataFrame]:
    """traces, steps and skipped of streams of tool lines (stream, n, line), n different in each line of a stream.

    steps (stream, n, step_number, step_type, name, input, output, error, close_n): tool_use and message lines in order, a call with what its result says. A failure
    is what an error that is not empty says; an error flag alone takes the result's text. traces (stream, status, error, total_tokens, answer, steps): a
    stream with an init, call or message, ended by the first result line after it; without one it is a timeout unless an error line came.
    skipped (stream, n, type, reason): results that no call takes, lines of unknown types, and lines that hold no object. Lines without a stream go nowhere.
    """
    v = F.col("v")
    rows = lines.where("stream is not null").select("stream", "n", V.parsed(F.col("line")).alias("v"))
    rows = cut(rows.select("stream", "n", "v", F.when(V.is_object(v), F.coalesce(V.scalar_text(v, "$.type"), F.lit(""))).alias("type")))
    matched = cut(pairs(lines, block))

    out = F.when(V.has(v, "$.output"), F.try_variant_get(v, "$.output", "variant")).otherwise(F.try_variant_get(v, "$.result", "variant"))
    wrap = lambda name, x: F.to_json(F.struct(x.alias(name)))
    ends = rows.where("type = 'tool_result'").withColumn("out", out)
    o = F.col("out")
    why = failure_text(v, "$.error")
    ends = ends.select(
        "stream", F.col("n").alias("close_n"), F.coalesce(F.when(V.is_text(o), wrap("output", V.text(o))), V.json(o)).alias("output"),
        F.when(why.isNotNull() | trueish(v, "$.is_error"), F.coalesce(why, failure_text(o, "$"), F.lit("tool failed"))).alias("error"),
    )
    done = matched.join(ends, ["stream", "close_n"]).withColumnRenamed("open_n", "n")
    base = rows.where("type in ('tool_use', 'message')")
    base = running(base, ("stream",), "n", {"step_number": F.lit(1)}, block=block)
    use = F.col("type") == "tool_use"
    content = F.when(V.has(v, "$.content"), F.try_variant_get(v, "$.content", "variant")).otherwise(F.try_variant_get(v, "$.text", "variant"))
    base = base.withColumn("content", content)
    c = F.col("content")
    said = F.coalesce(F.when(V.is_text(c), wrap("text", V.text(c))), V.json(c), F.lit("{}"))
    base = base.select(
        "stream", "n", F.col("step_number").cast("int").alias("step_number"), F.when(use, "tool_call").otherwise("output").alias("step_type"),
        F.when(use, F.coalesce(V.text(v, "$.name"), F.lit("tool"))).otherwise("message").alias("name"),
        F.when(use, F.coalesce(V.json(v, "$.input"), F.lit("{}"))).alias("input"), F.when(~use, said).alias("said"), F.when(~use, F.nullif(_text_of(c, "$"), F.lit(""))).alias("text"),
    )
    base = cut(base)
    steps = base.join(done, ["stream", "n"], "left").select("stream", "n", "step_number", "step_type", "name", "input", F.coalesce("said", "output").alias("output"), "error", "close_n")

    first = rows.where("type in ('init', 'tool_use', 'message')").groupBy("stream").agg(F.min("n").alias("start"))
    stops = rows.where("type = 'result'").select("stream", "n").join(first, "stream").where("n > start").groupBy("stream").agg(F.min("n").alias("stop"))
    span = first.join(stops, "stream", "left")
    raw = F.when(V.has(v, "$.exit_code"), F.try_variant_get(v, "$.exit_code", "variant")).otherwise(F.try_variant_get(v, "$.code", "variant"))
    code = F.coalesce(V.number(F.col("raw")), V.text(F.col("raw")).try_cast("double"))
    told = F.when(code == F.floor(code), code.cast("decimal(38,0)").cast("string")).otherwise(code.cast("string"))
    bad = (code != 0) & ~F.isnan(code) & (F.abs(code) < float("inf"))
    total = lambda at: F.coalesce(F.nullif(_count(v, f"{at}.total_tokens", f"{at}.total"), F.lit(0.0)), _count(v, f"{at}.input_tokens") + _count(v, f"{at}.output_tokens"))
    tokens = F.when(V.has(v, "$.usage"), total("$.usage")).otherwise(total("$.stats.tokens"))
    signs = rows.where("type in ('result', 'error')").withColumn("raw", raw).join(span, "stream").where("stop is null or n <= stop")
    fault = F.coalesce(V.text(v, "$.message"), V.text(v, "$.error.message"), F.lit("run failed"))
    is_error = F.col("type") == "error"
    signs = signs.groupBy("stream").agg(
        F.max(~is_error).alias("ended"), F.max_by(fault, F.when(is_error, F.col("n"))).alias("fault"),
        F.min_by(F.concat(F.lit("exited with code "), told), F.when(~is_error & bad, F.col("n"))).alias("exit"), F.sum(F.when(~is_error, tokens)).cast("bigint").alias("tokens"),
    )
    counted = base.join(span.select("stream", "stop"), "stream").groupBy("stream").agg(
        F.count("*").alias("steps"), F.max_by("text", F.when(F.col("text").isNotNull() & (F.col("stop").isNull() | (F.col("n") <= F.col("stop"))), F.col("n"))).alias("answer")
    )
    error = F.coalesce("fault", "exit")
    status = F.when(error.isNotNull(), "failed").when(F.col("ended"), "completed").otherwise("timeout")
    traces = first.join(signs, "stream", "left").join(counted, "stream", "left").select(
        "stream", status.alias("status"), error.alias("error"), F.nullif(F.col("tokens"), F.lit(0)).alias("total_tokens"), "answer", F.coalesce("steps", F.lit(0)).alias("steps")
    )

    known = F.col("type").isin("init", "tool_use", "message", "error", "result")
    alone = rows.where("type = 'tool_result'").join(matched.select("stream", F.col("close_n").alias("n")), ["stream", "n"], "left_anti")
    other = rows.where(F.col("type").isNull() | (~known & (F.col("type") != "tool_result")))
    skipped = alone.select("stream", "n", "type", F.lit("no open call").alias("reason")).union(
        other.select("stream", "n", "type", F.when(F.col("type").isNull(), "no object").otherwise("unknown type"))
    )
    return {"traces": traces, "steps": steps, "skipped": skipped}
