"""OTLP trace batches in JSON, read set-wise: batches to spans, and spans to what ingest.assemble_spans takes.

A batch is one row (seq, body), seq being its place in the order of delivery. A body that is no JSON yields no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import nanos_ms

_SCALAR = "stringValue: string, intValue: string, doubleValue: double, boolValue: boolean"
_VALUE = (
    f"struct<{_SCALAR}, arrayValue: struct<values: array<struct<{_SCALAR}>>>, kvlistValue: struct<values: array<struct<key: string, value: struct<{_SCALAR}>>>>>"
)
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
_SPAN = (
    "struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string,"
    f" attributes: {_ATTRS}, status: struct<code: string, message: string>, events: array<struct<name: string, attributes: {_ATTRS}>>>"
)
BODY = f"struct<resourceSpans: array<struct<resource: struct<attributes: {_ATTRS}>, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>>"

# The operations, kinds and attribute names of the instrumentation conventions in use.
ROOTS = ("invoke_agent", "invoke_workflow", "create_agent")
OPERATIONS = {
    "execute_tool": "tool_call", "chat": "llm_call", "generate_content": "llm_call", "text_completion": "llm_call",
    "embeddings": "retrieval", "retrieval": "retrieval", "plan": "thought",
}
KINDS = {
    "AGENT": "root", "CHAIN": "root", "TOOL": "tool_call", "LLM": "llm_call", "RETRIEVER": "retrieval", "EMBEDDING": "retrieval",
    "GUARDRAIL": "guard_check",
}
SPAN_KINDS = {"workflow": "root", "agent": "root", "tool": "tool_call", "task": "thought"}
TOKENS_IN = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt")
TOKENS_OUT = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion")
NAMES = ("gen_ai.tool.name", "tool.name", "traceloop.entity.name")
MODELS = ("gen_ai.request.model", "gen_ai.response.model", "llm.model_name")
SAID_IN = ("gen_ai.input.messages", "gen_ai.prompt", "input.value", "llm.prompts", "traceloop.entity.input")
SAID_OUT = ("gen_ai.output.messages", "gen_ai.completion", "output.value", "llm.completions", "traceloop.entity.output")
PROVIDERS = ("gen_ai.provider.name", "gen_ai.system", "llm.provider")
LOG_FAMILIES = ("gemini_cli.", "claude_code.")
TOKENS = ("gen_ai.usage.total_tokens", "llm.token_count.total")
COST = ("gen_ai.usage.cost", "cost_usd", "cost")


def decoded(attrs: Column) -> Column:
    """array<struct<key, value>> of attributes, values as text, arrays and lists of scalars as JSON. To be put in a column once."""

    def scalar(v: Column) -> Column:
        return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))

    def one(x: Column) -> Column:
        v = x["value"]
        listed = F.to_json(F.transform(v["arrayValue"]["values"], scalar))
        pairs = F.to_json(F.map_from_entries(F.transform(v["kvlistValue"]["values"], lambda e: F.struct(e["key"], scalar(e["value"])))))
        return F.struct(x["key"].alias("key"), F.coalesce(scalar(v), listed, pairs).alias("value"))

    return F.transform(attrs, one)


def attribute(attrs: Column, *names: str) -> Column:
    """Text of the first of these decoded attributes that is there; of a repeated key the last value counts."""

    def one(name: str) -> Column:
        return F.try_element_at(F.filter(attrs, lambda x: x["key"] == name), F.lit(-1))["value"]

    return F.coalesce(*map(one, names))


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def _amount(x: Column) -> Column:
    """A finite number above zero, else 0."""
    n = x.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n).otherwise(0.0)


def _step_type(name: Column, attrs: Column) -> Column:
    """root, or the type of the step that a span is: by operation, by kind, by request type, by the name's first word."""
    known = {r: "root" for r in ROOTS} | OPERATIONS
    of = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return F.coalesce(
        of(known, attribute(attrs, "gen_ai.operation.name")),
        of(KINDS, F.upper(attribute(attrs, "openinference.span.kind"))),
        of(SPAN_KINDS, F.lower(attribute(attrs, "traceloop.span.kind"))),
        F.when(attribute(attrs, "llm.request.type").isNotNull(), "llm_call"),
        of(known, F.regexp_extract(F.trim(name), r"^\S+", 0)),
        F.lit("thought"),
    )


def read_spans(batches: DataFrame) -> DataFrame:
    """(seq, trace_id, span_id, parent_id, name, step_type, start_ms, end_ms, tokens, cost_usd, error, service) of every span.

    A span without a trace id is a trace of its own, and one without a span id is never taken for another. An explicit OK
    status wins over a recorded exception and error.type; an error always has a message. Counts below zero are 0.
    """
    body = F.from_json("body", BODY)
    rows = batches.select("seq", F.posexplode(body["resourceSpans"]).alias("i", "r"))
    rows = rows.select("seq", "i", "r.resource", F.posexplode("r.scopeSpans").alias("j", "c"))
    rows = rows.select("seq", "i", "j", "resource", F.posexplode("c.spans").alias("k", "s"))
    raised = F.try_element_at(F.filter("s.events", lambda e: e["name"] == "exception"), F.lit(1))["attributes"]
    rows = rows.select("*", decoded(F.col("s.attributes")).alias("attrs"), decoded(raised).alias("raised"), decoded(F.col("resource.attributes")).alias("around"))
    place = F.struct("seq", "i", "j", "k")
    alone = F.concat(F.lit("!"), F.concat_ws(".", "seq", "i", "j", "k"))
    attrs, code, raised = F.col("attrs"), F.col("s.status.code"), F.col("raised")
    thrown = F.coalesce(_filled(attribute(raised, "exception.message")), _filled(attribute(raised, "exception.type")))
    kind = _filled(attribute(attrs, "error.type"))
    failed = code.isin("2", "STATUS_CODE_ERROR")
    fine = F.coalesce(code.isin("1", "STATUS_CODE_OK"), F.lit(False))
    text = F.coalesce(_filled(F.col("s.status.message")), thrown, kind, F.lit("error"))
    split = _amount(attribute(attrs, *TOKENS_IN)) + _amount(attribute(attrs, *TOKENS_OUT))
    millis = lambda c: nanos_ms(F.col(c))
    messages = lambda names: F.when(attribute(attrs, *names).isNotNull(), F.to_json(F.struct(attribute(attrs, *names).alias("messages"))))
    return rows.select(
        place.alias("seq"),
        F.coalesce(_filled(F.col("s.traceId")), alone).alias("trace_id"), F.coalesce(_filled(F.col("s.spanId")), alone).alias("span_id"),
        _filled(F.col("s.parentSpanId")).alias("parent_id"), F.col("s.name").alias("name"),
        _step_type(F.col("s.name"), attrs).alias("step_type"), millis("s.startTimeUnixNano").alias("start_ms"),
        millis("s.endTimeUnixNano").alias("end_ms"),
        F.when(split > 0, split).otherwise(_amount(attribute(attrs, *TOKENS))).cast("bigint").alias("tokens"),
        _amount(attribute(attrs, *COST)).alias("cost_usd"),
        F.when(F.coalesce(failed, F.lit(False)) | (~fine & F.coalesce(thrown, kind).isNotNull()), text).alias("error"),
        attribute(F.col("around"), "service.name").alias("service"),
        F.coalesce(_filled(attribute(attrs, *NAMES)), _filled(F.col("s.name")), attribute(attrs, "gen_ai.operation.name"), F.lit("span")).alias("step_name"),
        _filled(attribute(attrs, *MODELS)).alias("model"), messages(SAID_IN).alias("input"), messages(SAID_OUT).alias("output"),
        F.to_json(F.struct(F.col("s.spanId").alias("otel_span_id"), F.col("s.parentSpanId").alias("otel_parent_span_id"), attribute(attrs, *PROVIDERS).alias("provider"))).alias("metadata"),
        _filled(attribute(attrs, "gen_ai.agent.name")).alias("agent"), _filled(attribute(attrs, "gen_ai.conversation.id")).alias("session_id"),
    )


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Each span once, as it was delivered first, with its place among the spans of its trace: by start, those without one last. Spans are dealt once, by trace."""
    w = Window.partitionBy("trace_id", "span_id").orderBy("seq")
    own = spans.repartition("trace_id").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("start_ms").asc_nulls_last(), "seq")))


def span_steps(spans: DataFrame) -> DataFrame:
    """Steps of read_spans(), numbered anew by start over all batches. The first root stands for its trace and is no step.

    A parent counts where it is a step with a lower number, in whichever batch it came.
    """
    rows = distinct_spans(spans)
    first = F.min(F.when(F.col("step_type") == "root", F.col("place"))).over(Window.partitionBy("trace_id"))
    rows = rows.withColumn("root", first).where("root is null or place <> root")
    rows = rows.withColumn("step_number", (F.col("place") - F.when(F.col("root") < F.col("place"), 1).otherwise(0)).cast("int"))
    # a row under its parent's id meets the number under its own, so that the batches are read once
    whole = F.struct(*(c for c in rows.columns if c != "trace_id"))
    none = lambda kind: F.lit(None).cast(kind)
    both = F.array(
        F.struct(F.col("parent_id").alias("at"), none("int").alias("up"), whole.alias("x")),
        F.struct(F.col("span_id").alias("at"), F.col("step_number").alias("up"), none(rows.select(whole.alias("x")).schema["x"].dataType).alias("x")),
    )
    met = rows.select("trace_id", F.explode(both).alias("b")).select("trace_id", "b.*")
    met = met.withColumn("up", F.max("up").over(Window.partitionBy("trace_id", "at"))).where("x is not null")
    rows = met.select("trace_id", "x.*", F.when(F.col("at").isNotNull(), F.col("up")).alias("parent_step_number"))
    took = F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms") - F.col("start_ms"))
    return rows.select(
        "trace_id", "step_number", F.when(F.col("step_type") == "root", "thought").otherwise(F.col("step_type")).alias("step_type"), F.col("step_name").alias("name"),
        F.coalesce("input", F.lit("{}")).alias("input"), "output", took.alias("duration_ms"), F.nullif("tokens", F.lit(0)).alias("tokens_used"), "model", "error", "metadata",
        F.when(F.col("parent_step_number") < F.col("step_number"), F.col("parent_step_number")).alias("parent_step_number"),
    )


def span_traces(spans: DataFrame) -> DataFrame:
    """(trace_id, agent_name, session_id, input, output): of the first root, or else the first span that says something, so a root that comes late takes over."""
    rows = distinct_spans(spans)
    rank = F.struct(F.when(F.col("step_type") == "root", 0).otherwise(1), F.col("place"))
    of = lambda c, name: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(name)
    return rows.groupBy("trace_id").agg(
        F.coalesce(of("agent", "a"), of("service", "s"), F.lit("otel")).alias("agent_name"), of("session_id", "session_id"), of("input", "input"), of("output", "output")
    )


_RECORD = f"struct<timeUnixNano: string, eventName: string, name: string, attributes: {_ATTRS}, body: {_VALUE}>"
LOGS = f"struct<resourceLogs: array<struct<resource: struct<attributes: {_ATTRS}>, scopeLogs: array<struct<logRecords: array<{_RECORD}>>>>>>"


def read_logs(batches: DataFrame) -> DataFrame:
    """(sid, seq, ms, event, known, ...) of every log record of batches (seq, body). A record without a session is one of its own. Records are
    never taken for one another, as they have no ids."""
    rows = batches.select("seq", F.posexplode(F.from_json("body", LOGS)["resourceLogs"]).alias("i", "r"))
    rows = rows.select("seq", "i", "r.resource", F.posexplode("r.scopeLogs").alias("j", "c")).select("seq", "i", "j", "resource", F.posexplode("c.logRecords").alias("k", "l"))
    none = F.array().cast("array<struct<key: string, value: string>>")
    rows = rows.withColumn("attrs", F.concat(F.coalesce(decoded(F.col("resource.attributes")), none), F.coalesce(decoded(F.col("l.attributes")), none)))
    a = lambda *names: _filled(attribute(F.col("attrs"), *names))
    event = F.coalesce(_filled(F.col("l.eventName")), a("event.name"), _filled(F.col("l.name")), F.lit(""))
    known = F.lit(False)
    for family in LOG_FAMILIES:
        known |= event.startswith(family)
    amount = lambda *names: _amount(attribute(F.col("attrs"), *names))
    return rows.select(
        F.coalesce(a("session.id"), F.concat(F.lit("!"), F.concat_ws(".", "seq", "i", "j", "k"))).alias("sid"), F.struct("seq", "i", "j", "k").alias("seq"),
        nanos_ms(F.col("l.timeUnixNano")).alias("ms"), event.alias("event"), known.alias("known"),
        F.coalesce(a("prompt"), a("prompt_text"), _filled(F.col("l.body.stringValue"))).alias("prompt"),
        F.coalesce(a("function_name"), a("tool_name"), a("name"), F.lit("tool")).alias("tool"), a("function_args").alias("args"), a("decision").alias("decision"),
        F.lower(F.trim(a("success"))).alias("success"), F.coalesce(a("error"), a("error_message"), a("error_type")).alias("why"), a("status_code").alias("code"),
        a("gen_ai.request.model", "model").alias("model"), a("duration_ms").try_cast("bigint").alias("duration_ms"),
        (amount("input_token_count", "gen_ai.usage.input_tokens", "input_tokens") + amount("output_token_count", "gen_ai.usage.output_tokens", "output_tokens")).cast("bigint").alias("tokens"),
        amount("cost_usd", "cost", "gen_ai.usage.cost").alias("cost"),
    )


def recognised(logs: DataFrame) -> DataFrame:
    """(seq, records, accepted, rejected) of each batch of read_logs()."""
    return logs.groupBy(F.col("seq.seq").alias("seq")).agg(F.count("*").alias("records"), F.count_if("known").alias("accepted"), F.count_if(~F.col("known")).alias("rejected"))


def log_steps(logs: DataFrame) -> DataFrame:
    """(sid, step_number, step_type, name, output, error, model, duration_ms, chosen, decided_by, caused_by_step_number) of sessions in order of time, records without one last."""
    e = F.col("event")
    failed = F.col("success").isin("false", "0")
    error = F.when(failed, F.coalesce("why", F.lit("tool failed")))
    done = F.when(F.col("success").isNotNull(), F.to_json(F.struct("success")))
    none = F.lit(None).cast("string")
    kind = "struct<step_type: string, name: string, output: string, error: string, model: string, chosen: string, decided_by: string, caused: boolean>"
    one = lambda *values: F.struct(*values).cast(kind)
    tool = one(F.lit("tool_call"), F.col("tool"), done, error, none, none, none, F.lit(False))
    who = F.when(e.startswith("gemini_cli."), F.when(F.col("decision") == "auto_accept", "policy").otherwise("user")).otherwise(F.when(F.col("decision").isin("allow", "deny"), "user").otherwise("policy"))
    decided = one(F.lit("decision"), F.concat(F.lit("tool_decision:"), "tool"), none, none, none, F.col("decision"), who, e == "gemini_cli.tool_call")
    why = F.coalesce("why", F.when(F.col("code").isNotNull(), F.concat(F.lit("status "), "code")), F.lit("api error"))
    call = one(F.lit("llm_call"), F.coalesce("model", F.lit("api_error")), none, why, F.col("model"), none, none, F.lit(False))
    made = F.when(F.col("decision").isNotNull(), F.array(decided)).otherwise(F.array().cast(f"array<{kind}>"))
    steps = (
        F.when(e == "gemini_cli.tool_call", F.concat(F.array(tool), made)).when(e == "claude_code.tool_result", F.array(tool))
        .when(e == "claude_code.tool_decision", made).when(e.endswith(".api_error"), F.array(call))
    )
    rows = logs.where("known").select("sid", "seq", "ms", "duration_ms", F.posexplode(steps).alias("k", "x"))
    w = Window.partitionBy("sid").orderBy(F.col("ms").asc_nulls_last(), "seq", "k")
    rows = rows.withColumn("step_number", F.row_number().over(w).cast("int"))
    return rows.select(
        "sid", "step_number", "x.step_type", "x.name", "x.output", "x.error", "x.model", F.when(F.col("x.step_type") != "decision", F.col("duration_ms")).alias("duration_ms"),
        "x.chosen", "x.decided_by", F.when(F.col("x.caused"), F.col("step_number") - 1).alias("caused_by_step_number"),
    )


def log_traces(logs: DataFrame) -> DataFrame:
    """(session_id, agent_name, prompt, follow_ups, status, started_ms, ended_ms, total_tokens, total_cost_usd) of sessions that hold a step, a prompt or tokens."""
    rows = logs.where("known")
    e = F.col("event")
    asked = e.endswith(".user_prompt") & F.col("prompt").isNotNull()
    step = e.isin("gemini_cli.tool_call", "claude_code.tool_result") | e.endswith(".api_error") | ((e == "claude_code.tool_decision") & F.col("decision").isNotNull())
    use = e.endswith(".api_response") | e.endswith(".api_request")
    order = F.struct(F.coalesce("ms", F.lit(2**62)), F.col("seq"))
    out = rows.groupBy("sid").agg(
        F.max(e.startswith("gemini_cli.")).alias("gemini"), F.min_by("prompt", F.when(asked & (F.trim("prompt") != ""), order)).alias("prompt"), F.count_if(asked).alias("asked"),
        F.max(e.endswith(".api_error")).alias("failed"), F.min("ms").alias("started_ms"), F.max("ms").alias("ended_ms"), F.count_if(step).alias("steps"),
        F.nullif(F.sum(F.when(use, F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.nullif(F.sum(F.when(use, F.col("cost"))), F.lit(0.0)).alias("total_cost_usd"),
    ).where("steps > 0 or prompt is not null or total_tokens is not null")
    return out.select(
        F.when(~F.col("sid").startswith("!"), F.col("sid")).alias("session_id"), F.when(F.col("gemini"), "gemini").otherwise("claude-code").alias("agent_name"), "prompt",
        F.greatest(F.col("asked") - 1, F.lit(0)).cast("bigint").alias("follow_ups"), F.when(F.col("failed"), "failed").otherwise("completed").alias("status"),
        "started_ms", "ended_ms", "total_tokens", "total_cost_usd", "steps",
    )


def as_assembly(spans: DataFrame) -> DataFrame:
    """The spans as ingest.assemble_spans takes them: a root is what its operation calls one, whatever its parent."""
    parent = F.when(F.col("step_type") != "root", F.coalesce("parent_id", F.lit("")))
    return spans.select(
        "trace_id", "span_id", parent.alias("parent_id"), "start_ms", "end_ms", "tokens", "cost_usd", F.col("error").isNotNull().alias("failed"), "seq"
    )
