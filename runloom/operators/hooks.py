"""Tool-call hooks and vendor streams: payload rows to the steps and traces of their sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.workers import cut
from . import judge
from .ingest import pair_fifo

# Events of hooks and what they do, the events of one dialect only, and item types of an execution stream.
ACTIONS = {
    "SessionStart": "session_start", "UserPromptSubmit": "prompt", "BeforeAgent": "prompt", "PreToolUse": "pre_tool", "BeforeTool": "pre_tool",
    "PostToolUse": "post_tool", "AfterTool": "post_tool", "PostToolUseFailure": "post_tool_fail", "SubagentStart": "subagent_start",
    "SubagentStop": "subagent_stop", "Stop": "finalize", "AfterAgent": "finalize", "SessionEnd": "finalize",
}
GEMINI = ("BeforeTool", "AfterTool", "BeforeAgent", "AfterAgent", "BeforeModel", "AfterModel")
ITEM_TYPES = {
    "agent_message": "output", "reasoning": "thought", "command_execution": "tool_call", "mcp_tool_call": "tool_call", "file_change": "tool_call", "web_search": "retrieval",
}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def read_hooks(payloads: DataFrame) -> DataFrame:
    """(seq, ms, session, action, dialect, ...) of hook payloads (seq, ms, payload); an event that is none of the known ones has no action."""
    v = V.parsed(F.col("payload"))
    rows = payloads.select("seq", "ms", v.alias("v"), V.text(v, "$.hook_event_name").alias("event"))
    v, e = F.col("v"), F.col("event")
    action = _of(ACTIONS, e)
    by_time = e.isin("SessionStart", "SessionEnd") & ~V.has(v, "$.permission_mode") & V.has(v, "$.timestamp")
    dialect = F.when(e.isin(*GEMINI), "gemini").when(V.has(v, "$.turn_id"), "codex").when(by_time, "gemini").when(action.isNotNull(), "claude-code").otherwise("unknown")
    filled = lambda path: F.nullif(V.text(v, path), F.lit(""))
    return rows.select(
        "seq", "ms", F.coalesce(filled("$.session_id"), F.lit("unknown-session")).alias("session"), action.alias("action"), dialect.alias("dialect"),
        filled("$.tool_name").alias("tool"), filled("$.agent_id").alias("agent_id"), filled("$.agent_type").alias("agent_type"), filled("$.prompt").alias("prompt"),
        F.coalesce(V.json(v, "$.tool_input"), F.lit("{}")).alias("input"), F.coalesce(V.json(v, "$.tool_output"), V.json(v, "$.tool_response")).alias("output"),
        F.coalesce(filled("$.error"), F.when(~V.is_text(v, "$.error"), V.json(v, "$.error"))).alias("error"),
    )


def fold_hooks(hooks: DataFrame, policies: Sequence[judge.Policy] | None = None, no_input: bool = False) -> dict[str, DataFrame]:
    """traces (session, run, status, prompt, dialect) and steps of read_hooks().

    A run of a session begins with an event that opens something and ends with the next finalize. A result closes the oldest call of its session and tool that
    is open, in a finished run too, and opens nothing. A call of a sub-agent hangs on its latest anchor. With policies, a denied call is closed
    at once and a guard_check follows each call that is not allowed; a call without a tool is denied and not kept. no_input keeps payloads
    out of what is stored; policies see them.
    """
    rows = cut(hooks.where("action is not null"))
    opens = F.col("action").isin("session_start", "prompt", "pre_tool", "subagent_start")
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum(F.when(F.col("action") == "finalize", 1).otherwise(0)).over(before), F.lit(0)))
    own = rows.where(opens | (F.col("action") == "finalize"))
    traces = own.groupBy("session", "run").agg(
        F.max(opens).alias("opened"), F.max(F.col("action") == "finalize").alias("ended"),
        F.max_by("prompt", F.when((F.col("action") == "prompt") & F.col("prompt").isNotNull(), F.col("seq"))).alias("prompt"), F.min_by("dialect", F.when(opens, F.col("seq"))).alias("dialect"),
    ).where("opened")
    prompt = F.lit(None).cast("string") if no_input else F.col("prompt")
    traces = traces.select("session", "run", F.when(F.col("ended"), "completed").otherwise("running").alias("status"), prompt.alias("prompt"), "dialect")
    calls = rows.where("action = 'pre_tool'").withColumn("name", F.coalesce("tool", F.lit("tool")))
    verdict = ("verdict", "policy", "reasons")
    if policies is not None:
        calls = calls.where("tool is not null")
        as_steps = calls.select(F.col("session").alias("trace_id"), F.col("seq").alias("step_number"), F.lit("tool_call").alias("step_type"), "name", "input", F.lit(None).cast("string").alias("output"))
        found = judge.guard_matches(as_steps, policies)
        best = judge.guard_verdicts(found).join(found.select("trace_id", "step_number", "policy", "reasons"), ["trace_id", "step_number", "policy"])
        calls = calls.join(best.select(F.col("trace_id").alias("session"), F.col("step_number").alias("seq"), *verdict).where("verdict <> 'allow'"), ["session", "seq"], "left")
    else:
        calls = calls.withColumns({c: F.lit(None).cast("string") for c in verdict})
    calls = cut(calls)
    open_ = calls.where("verdict is null or verdict <> 'deny'").select("session", "seq", "name", F.lit("open").alias("event_type"))
    closing = rows.where("action in ('post_tool', 'post_tool_fail')").select("session", "seq", F.coalesce("tool", F.lit("tool")).alias("name"), F.lit("close").alias("event_type"))
    both = open_.union(closing).select(F.struct("session", "name").alias("key"), F.col("seq").alias("ts"), F.col("seq").alias("event_id"), "event_type")
    pairs = pair_fifo(both, "key", "open", "close").select(F.col("key.session").alias("session"), F.col("open_id").alias("seq"), "close_id").where("close_id is not null")
    done = rows.select("session", F.col("seq").alias("close_id"), F.col("output").alias("result"), F.col("ms").alias("end_ms"), (F.col("action") == "post_tool_fail").alias("bad"), F.col("error").alias("why"))
    closed = pairs.join(done, ["session", "close_id"])
    calls = calls.join(closed, ["session", "seq"], "left")
    denied = F.col("verdict") == "deny"
    blocked = F.concat(F.lit("blocked by policy "), "policy", F.lit(": "), "reasons")
    none = F.lit(None).cast("string")
    kept = F.lit("{}") if no_input else F.col("input")
    took = F.when(denied, 0).when(F.col("end_ms").isNotNull(), F.greatest(F.col("end_ms") - F.col("ms"), F.lit(0))).cast("bigint")
    error = F.when(denied, blocked).when(F.col("bad"), F.coalesce("why", F.lit("tool failed")))
    base = ("session", "run", "seq")
    tools = calls.select(*base, F.lit(0).alias("k"), F.lit("tool_call").alias("step_type"), "name", kept.alias("input"), F.col("result").alias("output"), error.alias("error"), took.alias("duration_ms"), "agent_id")
    told = F.to_json(F.struct(F.col("verdict").alias("action"), "policy", F.col("reasons").alias("reason")))
    nothing = F.lit(None).cast("bigint")
    guards = calls.where("verdict is not null").select(*base, F.lit(1).alias("k"), F.lit("guard_check").alias("step_type"), F.concat(F.lit("guard:"), "policy").alias("name"), F.lit("{}").alias("input"), told.alias("output"), none.alias("error"), nothing.alias("duration_ms"), none.alias("agent_id"))
    anchors = rows.where("action = 'subagent_start'").select(*base, F.lit(0).alias("k"), F.lit("thought").alias("step_type"), F.concat(F.lit("subagent:"), F.coalesce("agent_type", F.lit("subagent"))).alias("name"), F.lit("{}").alias("input"), none.alias("output"), none.alias("error"), nothing.alias("duration_ms"), "agent_id")
    steps = tools.union(guards).union(anchors)
    w = Window.partitionBy("session", "run").orderBy("seq", "k")
    steps = steps.withColumn("step_number", F.row_number().over(w).cast("int"))
    same = Window.partitionBy("session", "run", "agent_id").orderBy("seq", "k").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("step_type") == "thought", F.col("step_number")), ignorenulls=True).over(same)
    steps = steps.withColumn("parent_step_number", F.when((F.col("step_type") == "tool_call") & F.col("agent_id").isNotNull(), anchor))
    steps = steps.withColumn("caused_by_step_number", F.when(F.col("step_type") == "guard_check", F.col("step_number") - 1))
    return {"traces": traces, "steps": steps.drop("seq", "k", "agent_id")}


def failure_text(v: Column, path: str) -> Column:
    """What a failure flag says; false, 0, blank texts and empty containers say nothing."""
    n = V.number(v, path)
    json = V.json(v, path)
    return (
        F.when(V.is_text(v, path), F.when(F.trim(V.text(v, path)) != "", V.text(v, path))).when(V.is_number(v, path), F.when(n != 0, json))
        .when(~json.isin("false", "[]", "{}"), json)
    )


def trueish(v: Column, path: str) -> Column:
    """true, 1 and their texts."""
    return F.coalesce(F.lower(F.trim(V.scalar_text(v, path))).isin("true", "1"), F.lit(False))


def execution_stream(lines: DataFrame) -> dict[str, DataFrame]:
    """traces and steps of execution streams (stream, n, line): completed items are steps, usage adds up, a failed turn fails the run, and a
    stream that was cut off before its end stays a timeout."""
    v = V.parsed(F.col("line"))
    rows = cut(lines.select("stream", "n", v.alias("v"), V.text(v, "$.type").alias("type")).where("type is not null"))
    item = F.col("v")
    at = lambda name: f"$.item.{name}"
    kind = F.coalesce(V.text(item, at("item_type")), V.text(item, at("type")), F.lit("item"))
    items = rows.where("type = 'item.completed'").withColumn("kind", kind).withColumn("step_type", F.coalesce(_of(ITEM_TYPES, F.col("kind")), F.lit("thought")))
    code = F.coalesce(V.number(item, at("exit_code")), V.text(item, at("exit_code")).try_cast("double"))
    explicit = failure_text(item, at("error"))
    bad = trueish(item, at("is_error")) | (F.lower(F.trim(V.text(item, at("status")))) == "failed")
    error = F.coalesce(explicit, F.when(code != 0, F.concat(F.lit("exited with code "), code.cast("bigint").cast("string"))), F.when(bad, "tool failed"))
    command = V.text(item, at("command"))
    name = F.coalesce(V.text(item, at("name")), V.text(item, at("tool")), F.nullif(F.regexp_extract(F.trim(command), r"^\S+", 0), F.lit("")), F.col("kind"))
    w = Window.partitionBy("stream").orderBy("n")
    said = F.coalesce(*(V.text(item, at(c)) for c in ("text", "message", "content", "output")))
    steps = items.select(
        "stream", "n", F.row_number().over(w).cast("int").alias("step_number"), "step_type", name.alias("name"),
        F.when(V.has(item, at("command")), F.to_json(F.struct(command.alias("command")))).otherwise("{}").alias("input"), V.json(item, "$.item").alias("output"), error.alias("error"), said.alias("said"),
    )
    usage = sum((F.greatest(F.coalesce(V.number(item, f"$.usage.{c}"), F.lit(0.0)), F.lit(0.0)) for c in ("input_tokens", "output_tokens")), F.lit(0.0))
    failed = F.col("type").isin("turn.failed", "error")
    traces = rows.groupBy("stream").agg(
        F.nullif(F.sum(F.when(F.col("type") == "turn.completed", usage)).cast("bigint"), F.lit(0)).alias("total_tokens"), F.max(failed).alias("failed"),
        F.max(F.col("type") == "turn.completed").alias("ended"),
        F.max_by(F.coalesce(V.text(item, "$.error.message"), V.text(item, "$.message"), F.lit("run failed")), F.when(failed, F.col("n"))).alias("error"),
    )
    last = steps.groupBy("stream").agg(F.count("*").alias("steps"), F.max_by("said", F.when((F.col("step_type") == "output") & (F.col("said") != ""), F.col("n"))).alias("answer"))
    status = F.when(F.col("failed"), "failed").when(F.col("ended"), "completed").otherwise("timeout")
    out = traces.join(last, "stream", "left").select("stream", status.alias("status"), "error", "total_tokens", F.coalesce("steps", F.lit(0).cast("bigint")).alias("steps"), "answer")
    return {"traces": out, "steps": steps.drop("n", "said")}
