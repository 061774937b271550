"""Session files of agents, read set-wise over all files: lines, records, blocks, calls and their results, steps and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.workers import cut
from .ingest import prompts

MOST = 64 * 1024 * 1024  # characters of a line
USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
# Records of a rollout that are named by themselves, and its two kinds of calls.
ROLLOUT_TYPES = ("session_meta", "compacted", "message", "reasoning", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "token_count")
CALLS, OUTPUTS = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): the lines of text files, ended by \\n or \\r\\n, with their true numbers from 1.

    A huge file is read in splits. The ids of a split's lines follow each other, so a line's number is its place in its split and the count of the lines in
    the splits before, and the only window is over splits; no file is sorted, and lines are not shuffled where the splits are few enough to be broadcast.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("n"), F.rtrim("value", F.lit("\r")).alias("line"))


def documents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, bad) of files of JSON: docs (doc_id, body), bad (file, n), with every line of over MOST characters.

    A file whose first line that is neither blank nor a // comment is a value by itself holds a value a line, and lines that are none are bad;
    any other is one document. An array stands for its elements.
    """
    some = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("//"))
    long = some.where(F.length("line") > MOST).select("file", "n")
    rows = some.where(F.length("line") <= MOST).withColumn("v", V.parsed(F.col("line")))
    first = rows.groupBy("file").agg(F.min_by(F.col("v").isNotNull(), "n").alias("by_line"))
    rows = rows.join(first, "file")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    whole = rows.where("not by_line").groupBy("file").agg(F.min("n").alias("n"), one.alias("line")).withColumn("v", V.parsed(F.col("line")))
    every = rows.where("by_line").select("file", "n", "v").union(whole.select("file", "n", "v"))
    each = every.where("v is not null").select("file", "n", F.posexplode(F.when(V.is_array(F.col("v")), V.items(F.col("v"))).otherwise(F.array("v"))).alias("i", "x"))
    docs = each.select(F.concat_ws(":", "file", "n", "i").alias("doc_id"), F.to_json("x").alias("body"))
    return docs, every.where("v is null").select("file", "n").union(long)


def _plain(v: Column, path: str) -> Column:
    """Text of a content: a string, or the texts of an array's strings and blocks; else its JSON."""
    parts = F.transform(V.items(v, path), lambda b: F.coalesce(V.text(b), V.text(b, "$.text"), F.lit("")))
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    return F.coalesce(V.text(v, path), F.nullif(joined, F.lit("")), V.json(v, path), F.lit("null"))


def _numbered(steps: DataFrame, *order: str | Column) -> DataFrame:
    return steps.withColumn("step_number", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("int"))


def transcripts(lines: DataFrame) -> dict[str, DataFrame]:
    """traces and steps of transcripts (file, n, line), and of the sub-agents' files (file, agent, n, line) that belong to them.

    A call takes the last result of its id, and fails if any says so. Tokens are the four kinds of usage. The steps of a sub-agent come after
    the session's own, under a step that stands for it. imported and skipped count lines.
    """
    if "agent" not in lines.columns:
        lines = lines.withColumn("agent", F.lit(None).cast("string"))
    key = ["file", "agent"]
    rec = lines.where(F.trim("line") != "").select(*key, "n", V.parsed(F.col("line")).alias("v"))
    v = F.col("v")
    content = "$.message.content"
    one = F.array(F.struct(F.lit("text").alias("type"), V.text(v, content).alias("said"), F.lit(None).cast("variant").alias("b")))
    blocks = F.transform(V.items(v, content), lambda b: F.struct(V.text(b, "$.type").alias("type"), F.coalesce(V.text(b, "$.text"), F.lit("")).alias("said"), b.alias("b")))
    rec = rec.withColumn("type", F.when(V.is_object(v), V.text(v, "$.type")))
    talk = rec.where(F.col("type").isin("user", "assistant")).select(*key, "n", F.col("type").alias("role"), F.when(V.is_text(v, content), one).otherwise(blocks).alias("blocks"))
    each = cut(talk.select(*key, "n", "role", F.posexplode("blocks").alias("i", "x")).select(*key, "n", "i", "role", "x.*"))
    b = F.col("b")
    results = each.where((F.col("type") == "tool_result") & V.text(b, "$.tool_use_id").isNotNull()).select(
        *key, V.text(b, "$.tool_use_id").alias("call"), "n", "i", _plain(b, "$.content").alias("result"),
        F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)).alias("failed"),
    )
    done = results.groupBy(*key, "call").agg(F.max_by("result", F.struct("n", "i")).alias("result"), F.max("failed").alias("failed"))
    kind = (
        F.when(F.col("type") == "tool_use", "tool_call").when(F.col("type") == "thinking", "thought")
        .when((F.col("type") == "text") & (F.col("role") == "assistant") & ((F.col("said") != "") | b.isNull()), "output")
    )
    said = F.when(F.col("type") == "thinking", F.coalesce(V.text(b, "$.thinking"), F.col("said"))).otherwise(F.col("said"))
    steps = each.withColumn("step_type", kind).where("step_type is not null").select(
        *key, "n", "i", "step_type", V.text(b, "$.id").alias("call"),
        F.when(F.col("type") == "tool_use", F.coalesce(F.nullif(V.text(b, "$.name"), F.lit("")), F.lit("tool")))
        .when(F.col("type") == "thinking", "thinking").otherwise("assistant_message").alias("name"),
        F.when(F.col("type") == "tool_use", F.coalesce(V.json(b, "$.input"), F.lit("{}"))).otherwise("{}").alias("input"), said.alias("said"),
    )
    same = steps.join(
        done.withColumnsRenamed({"file": "f", "agent": "a", "call": "c"}),
        F.expr("file = f and agent <=> a and call = c"), "left",
    ).drop("f", "a", "c")
    obj = lambda name, x: F.to_json(F.struct(x.alias(name)))
    tool = F.col("step_type") == "tool_call"
    same = same.select(
        *key, "n", "i", "step_type", "name", "input",
        F.when(~tool, obj("text", F.col("said"))).when(F.col("result").isNotNull(), obj("result", F.col("result"))).alias("output"),
        F.when(tool & F.col("failed"), F.coalesce(F.nullif("result", F.lit("")), F.lit("tool failed"))).alias("error"),
    )
    none = F.lit(None).cast("string")
    anchors = same.where("agent is not null").select(*key).distinct().select(
        *key, F.lit(-1).alias("n"), F.lit(0).alias("i"), F.lit("thought").alias("step_type"), F.concat(F.lit("subagent:"), "agent").alias("name"),
        F.lit("{}").alias("input"), none.alias("output"), none.alias("error"),
    )
    every = _numbered(same.union(anchors), F.col("agent").asc_nulls_first(), "n", "i")
    top = F.min("step_number").over(Window.partitionBy("file", "agent"))
    every = every.withColumn("parent_step_number", F.when(F.col("agent").isNotNull() & (F.col("n") >= 0), top))
    paired = results.join(steps.where("call is not null").select(*(F.col(c).alias(f"_{c}") for c in (*key, "call"))).distinct(), F.expr("file = _file and agent <=> _agent and call = _call"), "left_semi")
    asked = each.where("agent is null and type = 'text' and role = 'user' and trim(said) <> ''")
    good = (asked.select(*key, "n").union(same.select(*key, "n")).union(paired.select(*key, "n"))).distinct().groupBy("file").agg(F.count("*").alias("imported"))
    usage = [F.greatest(F.coalesce(F.when(V.is_number(v, f"$.message.usage.{c}") | V.is_text(v, f"$.message.usage.{c}"), F.try_variant_get(v, f"$.message.usage.{c}", "double")), F.lit(0.0)), F.lit(0.0)) for c in USAGE]
    counted = F.when(F.col("type").isin("user", "assistant"), sum(usage[1:], usage[0]))
    main = F.col("agent").isNull()
    stamp = V.text(v, "$.timestamp")
    per = rec.groupBy("file").agg(
        F.min_by(V.text(v, "$.sessionId"), F.when(main & V.text(v, "$.sessionId").isNotNull(), F.col("n"))).alias("session_id"),
        F.min_by(stamp, F.when(main & stamp.isNotNull(), F.col("n"))).alias("started_at"), F.max_by(stamp, F.when(main & (stamp != ""), F.col("n"))).alias("ended_at"),
        F.nullif(F.sum(counted).cast("bigint"), F.lit(0)).alias("total_tokens"), F.count("*").alias("lines"),
    )
    turns = each.where("agent is null and type = 'text'").select("file", F.struct("n", "i").alias("turn"), "role", F.col("said").alias("text")).where("role = 'user' or text <> ''")
    count = every.groupBy("file").agg(F.count("*").alias("steps"))
    traces = per.join(prompts(turns, "file").drop("steps"), "file", "left").join(count, "file", "left").join(good, "file", "left")
    zero = F.lit(0).cast("bigint")
    traces = traces.select(
        "file", "session_id", "started_at", "ended_at", "prompt", "preamble", "follow_ups", "answer", "total_tokens", F.coalesce("steps", zero).alias("steps"),
        F.coalesce("imported", zero).alias("imported"), (F.col("lines") - F.coalesce("imported", zero)).alias("skipped"),
    ).where("steps > 0 or prompt is not null")
    return {"traces": traces, "steps": every.select("file", "step_number", "step_type", "name", "input", "output", "error", "parent_step_number")}


def failure(result: Column, obj: Column) -> Column:
    """What a call's result, and its value as JSON, say of a failure: a failed script, an exit code, success false or an error; null for none."""
    line = F.trim(F.substring_index(result, "\n", 1))
    code = F.coalesce(V.number(obj, "$.metadata.exit_code"), V.number(obj, "$.exit_code"))
    error = F.coalesce(V.text(obj, "$.error"), V.json(obj, "$.error"), V.text(obj, "$.metadata.error"), V.json(obj, "$.metadata.error"))
    told = F.lower(V.scalar_text(obj, "$.success")) == "false"
    return (
        F.when(line.rlike(r"(?i)^Script (failed|error)\b"), F.coalesce(F.nullif(F.trim(F.substring(result, 1, 500)), F.lit("")), F.lit("tool failed")))
        .when(V.is_object(obj) & (code != 0), F.concat(F.lit("exited with code "), code.cast("bigint").cast("string")))
        .when(V.is_object(obj) & told, F.coalesce(F.nullif(V.text(obj, "$.output"), F.lit("")), F.lit("tool reported failure")))
        .when(V.is_object(obj) & error.isNotNull(), F.coalesce(F.nullif(error, F.lit("")), F.lit("error")))
    )


def rollouts(lines: DataFrame) -> dict[str, DataFrame]:
    """traces and steps of rollouts (file, n, line). Of a running token counter the last reading counts; a call takes the last output of its id."""
    rec = lines.where(F.trim("line") != "").select("file", "n", V.parsed(F.col("line")).alias("v"))
    v = F.col("v")
    inner = F.coalesce(F.when(V.is_object(v, "$.payload"), F.try_variant_get(v, "$.payload", "variant")), F.when(V.is_object(v, "$.item"), F.try_variant_get(v, "$.item", "variant")), v)
    rec = rec.withColumn("it", inner)
    it = F.col("it")
    outer = V.text(v, "$.type")
    rec = rec.withColumn("type", F.when(outer.isin(*ROLLOUT_TYPES), outer).otherwise(F.coalesce(V.text(it, "$.type"), outer)))
    call = V.scalar_text(it, "$.call_id")
    text = F.coalesce(F.nullif(_plain(it, "$.content"), F.lit("null")), V.text(it, "$.text"), F.lit(""))
    thought = F.coalesce(*(F.nullif(_plain(it, f"$.{c}"), F.lit("null")) for c in ("summary", "content", "text")), F.lit(""))
    rec = rec.select(
        "file", "n", "type", call.alias("call"), V.text(it, "$.role").alias("role"), F.when(F.col("type") == "reasoning", thought).otherwise(text).alias("said"),
        F.coalesce(F.nullif(V.text(it, "$.name"), F.lit("")), F.lit("tool")).alias("tool"), F.coalesce(V.payload(it, "$.arguments"), V.payload(it, "$.input"), F.lit("{}")).alias("args"),
        _plain(it, "$.output").alias("result"), V.number(it, "$.info.total_token_usage.total_tokens").cast("bigint").alias("total"),
        F.coalesce(V.text(it, "$.id"), V.text(it, "$.session_id")).alias("session"), F.coalesce(F.nullif(V.text(v, "$.timestamp"), F.lit("")), V.text(it, "$.timestamp")).alias("stamp"),
        V.text(it, "$.timestamp").alias("own_stamp"),
    )
    rec = cut(rec)
    outs = rec.where(F.col("type").isin(*OUTPUTS) & F.col("call").isNotNull()).groupBy("file", "call").agg(F.max_by("result", "n").alias("output"))
    kind = (
        F.when(F.col("type").isin(*CALLS), "tool_call").when(F.col("type") == "reasoning", "thought")
        .when((F.col("type") == "message") & (F.col("role") == "assistant") & (F.col("said") != ""), "output")
    )
    steps = rec.withColumn("step_type", kind).where("step_type is not null").drop("result")
    steps = _numbered(steps.join(outs, ["file", "call"], "left"), "n").withColumn("obj", V.parsed(F.col("output")))
    tool = F.col("step_type") == "tool_call"
    name = F.when(tool, F.col("tool")).when(F.col("step_type") == "thought", "reasoning").otherwise("assistant_message")
    obj = lambda key, x: F.to_json(F.struct(x.alias(key)))
    listed = steps.select(
        "file", "step_number", "step_type", name.alias("name"), F.when(tool, F.col("args")).otherwise("{}").alias("input"),
        F.when(~tool, obj("text", F.col("said"))).when(F.col("output").isNotNull(), obj("output", F.col("output"))).alias("output"),
        F.when(tool, failure(F.col("output"), F.col("obj"))).alias("error"),
    )
    calls = steps.where("step_type = 'tool_call' and call is not null").select("file", "call").distinct().withColumn("known", F.lit(True))
    rows = rec.join(calls, ["file", "call"], "left")
    t = F.col("type")
    fine = (
        t.isin("session_meta", "token_count", "compacted", "reasoning", *CALLS) | (t.isin(*OUTPUTS) & F.coalesce("known", F.lit(False)))
        | ((t == "message") & (((F.col("role") == "user") & (F.trim("said") != "")) | ((F.col("role") == "assistant") & (F.col("said") != ""))))
    )
    per = rows.groupBy("file").agg(
        F.max_by("session", F.when((t == "session_meta") & F.col("session").isNotNull(), F.col("n"))).alias("session_id"),
        F.max_by("own_stamp", F.when((t == "session_meta") & F.col("own_stamp").isNotNull(), F.col("n"))).alias("started_at"),
        F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("n"))).alias("ended_at"),
        F.max_by("total", F.when((t == "token_count") & F.col("total").isNotNull(), F.col("n"))).alias("total_tokens"),
        F.coalesce(F.max(t == "compacted"), F.lit(False)).alias("compacted"), F.count_if(fine).alias("imported"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("skipped"),
    )
    turns = rec.where("type = 'message' and role in ('user', 'assistant')").select("file", F.col("n").alias("turn"), "role", F.col("said").alias("text"))
    spoken = prompts(turns.where("role = 'user' or text <> ''"), "file").drop("steps")
    count = listed.groupBy("file").agg(F.count("*").alias("steps"))
    traces = per.join(spoken, "file", "left").join(count, "file", "left").withColumn("steps", F.coalesce("steps", F.lit(0).cast("bigint")))
    return {"traces": traces.where("steps > 0 or prompt is not null"), "steps": listed}


def replaced(stored: DataFrame, incoming: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to write, to delete) of imports known by (session_id, source_format, source_file): what is there already is left out, or replaces the old one.

    stored: traces with id, parent_trace_id and these three. An old trace that forks derive from is never replaced.
    """
    key = ["session_id", "source_format", "source_file"]
    own = stored.where("parent_trace_id is null")
    same = [own[k].eqNullSafe(incoming[k]) for k in key]
    if not replace:
        return incoming.join(own, same[0] & same[1] & same[2], "left_anti"), own.select("id").limit(0)
    parents = stored.where("parent_trace_id is not null").select(F.col("parent_trace_id").alias("__p")).distinct()
    held = own.join(parents, F.col("id") == F.col("__p"), "left_semi")
    free = own.join(parents, F.col("id") == F.col("__p"), "left_anti")
    stay = [held[k].eqNullSafe(incoming[k]) for k in key]
    write = incoming.join(held, stay[0] & stay[1] & stay[2], "left_anti")
    gone = [free[k].eqNullSafe(write[k]) for k in key]
    return write, free.join(write, gone[0] & gone[1] & gone[2], "left_semi").select("id")
