"""Named queries over OTLP traces and logs, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import otlp
from ..sources.fixtures import Store, table
from .queries import query


def attribute(key: str, value: str) -> str:
    return f"named_struct('key', '{key}', 'value', named_struct('stringValue', {value}))"


def span_batches(s: Store) -> DataFrame:
    """Line items as spans, one a batch and every seventh part delivered twice. Spans of odd traces come in reverse; the first of a trace is its root unless the supplier is odd,
    others hang on the second."""
    rows = s.steps.selectExpr("*", "trace_key * 1000L + if(trace_key % 2 = 1, 100 - step_number, step_number) as at", "step_number = 1 and suppkey % 2 = 0 as root")
    attributes = ", ".join([
        attribute("gen_ai.operation.name", "if(root, 'invoke_agent', 'execute_tool')"), attribute("gen_ai.tool.name", "if(partkey % 3 = 0, name, null)"),
        attribute("gen_ai.prompt", "concat('p', partkey)"), attribute("gen_ai.request.model", "model"), attribute("gen_ai.agent.name", "if(root, concat('agent', suppkey), null)"),
        attribute("gen_ai.usage.input_tokens", "cast(tokens_used as string)"),
    ])
    one = rows.selectExpr(
        "step_number as seq", "partkey", "to_json(named_struct('resourceSpans', array(named_struct('scopeSpans', array(named_struct('spans', array(named_struct('traceId', trace_id, 'spanId', concat('s', step_number),"
        " 'parentSpanId', case when step_number > 2 then 's2' when step_number = 2 then 's1' end, 'name', 'step', 'startTimeUnixNano', cast(at * 1000000L as string), 'endTimeUnixNano', cast((at + 5) * 1000000L as string),"
        f" 'attributes', array({attributes}), 'status', named_struct('code', if(error is not null, 2, 0)))))))))) as body",
    )
    return one.drop("partkey").union(one.where("partkey % 7 = 0").selectExpr("seq + 100", "body"))


SPANS = """, x as (select *, trace_key * 1000 + case when trace_key % 2 = 1 then 100 - step_number else step_number end as moment, step_number = 1 and suppkey % 2 = 0 as root from steps),
 p as (select *, row_number() over (partition by trace_id order by moment) as place from x), r as (select trace_id as rt, place as rp from p where root),
 n as (select p.*, place - case when rp < place then 1 else 0 end as number from p left join r on rt = trace_id where not root),
 q as (select n.*, u.number as up from n left join n u on u.trace_id = n.trace_id and u.step_number = case when n.step_number > 2 then 2 when n.step_number = 2 then 1 end)
"""
query("otlp_steps", f"""{SPANS} select trace_id, cast(number as int) as step_number, 'tool_call' as step_type, case when partkey % 3 = 0 then name else 'step' end as name,
 concat('{{"messages":"p', cast(partkey as string), '"}}') as input, 5 as duration_ms, nullif(coalesce(tokens_used, 0), 0) as tokens_used, model,
 case when error is not null then 'error' end as error, cast(case when up < number then up end as int) as parent_step_number from q""")(
    lambda s: otlp.span_steps(otlp.read_spans(span_batches(s))).select("trace_id", "step_number", "step_type", "name", "input", "duration_ms", "tokens_used", "model", "error", "parent_step_number")
)
query("otlp_traces", """, x as (select *, step_number = 1 and suppkey % 2 = 0 as root, row_number() over (partition by trace_id order by case when trace_key % 2 = 1 then 100 - step_number else step_number end) as place from steps)
 select trace_id, coalesce(max(case when root then concat('agent', cast(suppkey as string)) end), 'otel') as agent_name,
 coalesce(max(case when root then concat('{"messages":"p', cast(partkey as string), '"}') end), max(case when place = 1 then concat('{"messages":"p', cast(partkey as string), '"}') end)) as input from x group by 1""")(
    lambda s: otlp.span_traces(otlp.read_spans(span_batches(s))).select("trace_id", "agent_name", "input")
)


def log_batches(s: Store) -> DataFrame:
    """Events as log records, one a batch; every seventh user has no session, and every eleventh record is of another family."""
    attributes = ", ".join([
        attribute("session.id", "if(user_id % 7 = 0, null, concat('u', user_id))"), attribute("function_name", "if(event_type = 'click', concat('f', event_id % 5), null)"),
        attribute("decision", "if(event_type = 'click', case event_id % 3 when 0 then 'auto_accept' when 1 then 'accept' end, null)"),
        attribute("success", "if(event_type in ('click', 'view'), if(event_id % 4 = 0, 'False', 'true'), null)"), attribute("tool_name", "if(event_type = 'view', 'look', null)"),
        attribute("status_code", "if(event_type = 'error', '429', null)"), attribute("prompt", "if(event_type = 'signup', concat('ask ', event_id), null)"),
        attribute("input_token_count", "if(event_type = 'purchase', cast(event_id % 100 as string), null)"), attribute("cost", "if(event_type = 'purchase', '0.5', null)"),
    ])
    kind = "case event_type when 'click' then 'gemini_cli.tool_call' when 'view' then 'claude_code.tool_result' when 'error' then 'gemini_cli.api_error' when 'signup' then 'claude_code.user_prompt' else 'gemini_cli.api_response' end"
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "event_id as seq", "to_json(named_struct('resourceLogs', array(named_struct('scopeLogs', array(named_struct('logRecords', array(named_struct("
        f"'timeUnixNano', if(event_id % 13 = 0, '0', cast(event_id * 1000000000000L as string)), 'eventName', if(event_id % 11 = 0, 'other.event', {kind}), 'attributes', array({attributes}))))))))) as body",
    )


LOGS = """with e as (select *, case when user_id % 7 = 0 then null else concat('u', cast(user_id as string)) end as sid, case when event_id % 13 = 0 then null else event_id * 1000000 end as ms
 from events where event_id % 11 <> 0), g as (select *, coalesce(sid, concat('!', cast(event_id as string))) as k from e)
"""
query("log_steps", f"""{LOGS}, s as (select k, sid, ms, event_id, 0 as j, case event_type when 'error' then 'llm_call' else 'tool_call' end as step_type,
 case event_type when 'click' then concat('f', cast(event_id % 5 as string)) when 'view' then 'look' else 'api_error' end as name,
 case when event_type = 'error' then 'status 429' when event_id % 4 = 0 then 'tool failed' end as error, null as chosen, null as decided_by from g where event_type in ('click', 'view', 'error')
 union all select k, sid, ms, event_id, 1, 'decision', concat('tool_decision:f', cast(event_id % 5 as string)), null, case event_id % 3 when 0 then 'auto_accept' else 'accept' end,
 case event_id % 3 when 0 then 'policy' else 'user' end from g where event_type = 'click' and event_id % 3 < 2),
 n as (select *, row_number() over (partition by k order by ms nulls last, event_id, j) as step_number from s)
 select sid, cast(step_number as int) as step_number, step_type, name, error, chosen, decided_by, cast(case when j = 1 then step_number - 1 end as int) as caused_by_step_number from n""", raw=True)(
    lambda s: otlp.log_steps(otlp.read_logs(log_batches(s))).selectExpr("if(sid like '!%', null, sid) as sid", "step_number", "step_type", "name", "error", "chosen", "decided_by", "caused_by_step_number")
)
query("log_traces", f"""{LOGS} select sid as session_id, case when bool_or(event_type in ('click', 'error', 'purchase')) then 'gemini' else 'claude-code' end as agent_name,
 concat('ask ', cast(arg_min(event_id, coalesce(ms, 4611686018427387904)) filter (event_type = 'signup') as string)) as prompt, greatest(count(*) filter (event_type = 'signup') - 1, 0) as follow_ups,
 case when bool_or(event_type = 'error') then 'failed' else 'completed' end as status, min(ms) as started_ms, max(ms) as ended_ms,
 cast(nullif(sum(event_id % 100) filter (event_type = 'purchase'), 0) as bigint) as total_tokens, nullif(count(*) filter (event_type = 'purchase') * 0.5::double, 0) as total_cost_usd
 from g group by k, sid having count(*) filter (event_type <> 'purchase') > 0 or sum(event_id % 100) filter (event_type = 'purchase') > 0""", raw=True)(
    lambda s: otlp.log_traces(otlp.read_logs(log_batches(s))).selectExpr(
        "session_id", "agent_name", "coalesce(prompt, 'ask ') as prompt", "follow_ups", "status", "started_ms", "ended_ms", "total_tokens", "total_cost_usd"
    )
)
query("log_counts", "select event_id as seq, 1 as records, case when event_id % 11 <> 0 then 1 else 0 end as accepted, case when event_id % 11 = 0 then 1 else 0 end as rejected from events", raw=True)(
    lambda s: otlp.recognised(otlp.read_logs(log_batches(s)))
)
