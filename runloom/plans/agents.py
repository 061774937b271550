"""Named queries over hooks and execution streams, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enforce, hooks, judge, replies
from ..sources.fixtures import Store, table
from .queries import query


def payloads(s: Store) -> DataFrame:
    """Events as hook payloads of a session a user; a third of the calls come from one of two sub-agents."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "event_id as seq", "event_id * 10L as ms",
        "to_json(named_struct('hook_event_name', case event_type when 'click' then 'PreToolUse' when 'view' then 'PostToolUse' when 'error' then 'PostToolUseFailure'"
        " when 'signup' then if(event_id % 2 = 0, 'UserPromptSubmit', 'SubagentStart') else if(event_id % 5 = 0, 'Unknown', 'Stop') end, 'session_id', cast(user_id as string),"
        " 'tool_name', if(event_type in ('click', 'view', 'error'), concat('t', event_id % 3), null), 'agent_id', if(event_id % 3 = 1 or event_type = 'signup', concat('a', event_id % 2), null),"
        " 'prompt', if(event_type = 'signup', concat('p', event_id), null), 'tool_input', named_struct('n', event_id), 'tool_output', if(event_type = 'view', named_struct('r', event_id), null),"
        " 'error', if(event_id % 2 = 0, 'bad', null))) as payload",
    )


GUARDS = (judge.Policy("no-t1", "deny", 5, name_contains="T1"), judge.Policy("ask-7", "require_review", 9, input_contains='":7'), judge.Policy("fine", "allow", 50, step_type="tool_call"))
HOOKS = """with e as (select event_id as seq, cast(user_id as string) as session, case event_type when 'click' then 'pre' when 'view' then 'post' when 'error' then 'fail' when 'signup' then
 case when event_id % 2 = 0 then 'prompt' else 'anchor' end else case when event_id % 5 = 0 then null else 'end' end end as a, concat('t', cast(event_id % 3 as string)) as tool,
 case when event_id % 3 = 1 or event_type = 'signup' then concat('a', cast(event_id % 2 as string)) end as agent from events),
 r as (select *, cast(coalesce(sum(case when a = 'end' then 1 else 0 end) over (partition by session order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as run from e where a is not null),
 f as (select *, a = 'pre' as up from r where a in ('pre', 'post', 'fail') and not ({deny})),
 x as (select *, sum(case when up then -1 else 1 end) over (partition by session, tool order by seq) as excess from f), y as (select *, greatest(0, max(excess) over (partition by session, tool order by seq)) as void from x),
 g as (select *, void > coalesce(lag(void) over (partition by session, tool order by seq), 0) as lost from y), o as (select *, row_number() over (partition by session, tool, up order by seq) as nth from g where up or not lost),
 c as (select p.seq, q.seq as done, q.a as how from o p left join o q on q.session = p.session and q.tool = p.tool and q.nth = p.nth and not q.up where p.up)
"""
query("hook_traces", HOOKS.format(deny="false") + """ select session, run, case when bool_or(a = 'end') then 'completed' else 'running' end as status, arg_max(concat('p', cast(seq as string)), seq) filter (a = 'prompt') as prompt,
 'claude-code' as dialect from r where a in ('pre', 'prompt', 'anchor', 'end') group by 1, 2 having bool_or(a <> 'end')""", raw=True)(
    lambda s: hooks.fold_hooks(hooks.read_hooks(payloads(s)))["traces"]
)
_STEPS = """, s as (select session, run, r.seq, 0 as k, case a when 'pre' then 'tool_call' else 'thought' end as step_type, case a when 'pre' then tool else 'subagent:subagent' end as name, agent, done, how, a
 from r left join c on c.seq = r.seq where a in ('pre', 'anchor')), n as (select *, row_number() over (partition by session, run order by seq) as number from s),
 p as (select *, last_value(case when a = 'anchor' then number end ignore nulls) over (partition by session, run, agent order by seq rows between unbounded preceding and 1 preceding) as up from n)
"""
query("hook_steps", HOOKS.format(deny="false") + _STEPS + """ select session, run, cast(number as int) as step_number, step_type, name, case when a = 'pre' then concat('{"n":', cast(seq as string), '}') else '{}' end as input,
 case when how = 'post' then concat('{"r":', cast(done as string), '}') end as output, case when how = 'fail' then case when done % 2 = 0 then 'bad' else 'tool failed' end end as error,
 (done - seq) * 10 as duration_ms, cast(case when a = 'pre' and agent is not null then up end as int) as parent_step_number, cast(null as int) as caused_by_step_number from p""", raw=True)(
    lambda s: hooks.fold_hooks(hooks.read_hooks(payloads(s)))["steps"]
)
query("hook_enforced", HOOKS.format(deny="a = 'pre' and tool = 't1'") + """, v as (select *, case when a = 'pre' and tool = 't1' then 'deny' when a = 'pre' and cast(seq as string) like '7%' then 'require_review' end as verdict
 from r where a in ('pre', 'anchor')), t as (select session, run, v.seq, 0 as k, case a when 'pre' then 'tool_call' else 'thought' end as step_type, case a when 'pre' then tool else 'subagent:subagent' end as name,
 case when verdict = 'deny' then 'blocked by policy no-t1: name contains T1' when how = 'fail' then case when done % 2 = 0 then 'bad' else 'tool failed' end end as error from v left join c on c.seq = v.seq
 union all select session, run, seq, 1, 'guard_check', case verdict when 'deny' then 'guard:no-t1' else 'guard:ask-7' end, null from v where verdict is not null),
 n as (select *, row_number() over (partition by session, run order by seq, k) as number from t)
 select session, run, cast(number as int) as step_number, step_type, name, '{}' as input, error, cast(case when k = 1 then number - 1 end as int) as caused_by_step_number from n""", raw=True)(
    lambda s: hooks.fold_hooks(hooks.read_hooks(payloads(s)), GUARDS, no_input=True)["steps"].select("session", "run", "step_number", "step_type", "name", "input", "error", "caused_by_step_number")
)


def execution_lines(s: Store) -> DataFrame:
    """Events as lines of execution streams, a stream a user."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "concat('u', user_id) as stream", "cast(event_id as int) as n",
        "to_json(named_struct('type', case event_type when 'purchase' then if(event_id % 7 = 0, 'turn.failed', 'turn.completed') when 'signup' then 'thread.started' else 'item.completed' end,"
        " 'usage', named_struct('input_tokens', event_id % 100, 'output_tokens', -5), 'error', named_struct('message', concat('m', event_id)), 'item', if(event_type in ('click', 'view', 'error'), named_struct("
        " 'type', case event_type when 'click' then 'command_execution' when 'view' then 'agent_message' else 'odd' end, 'command', if(event_type = 'click', 'ls -l', null), 'text', if(event_type = 'view', concat('say ', event_id), null),"
        " 'exit_code', if(event_type = 'click', cast(event_id % 3 as string), null), 'is_error', if(event_type = 'error', if(event_id % 2 = 0, '1', 'no'), null)), null))) as line",
    )


query("execution_steps", """select concat('u', cast(user_id as string)) as stream, cast(row_number() over (partition by user_id order by event_id) as int) as step_number,
 case event_type when 'click' then 'tool_call' when 'view' then 'output' else 'thought' end as step_type, case event_type when 'click' then 'ls' when 'view' then 'agent_message' else 'odd' end as name,
 case when event_type = 'click' then '{"command":"ls -l"}' else '{}' end as input, case when event_type = 'click' and event_id % 3 <> 0 then concat('exited with code ', cast(event_id % 3 as string))
 when event_type = 'error' and event_id % 2 = 0 then 'tool failed' end as error from events where event_type in ('click', 'view', 'error')""", raw=True)(
    lambda s: hooks.execution_stream(execution_lines(s))["steps"].drop("output")
)
query("execution_traces", """select concat('u', cast(user_id as string)) as stream, case when bool_or(event_type = 'purchase' and event_id % 7 = 0) then 'failed' when bool_or(event_type = 'purchase' and event_id % 7 <> 0) then 'completed'
 else 'timeout' end as status, concat('m', cast(max(event_id) filter (event_type = 'purchase' and event_id % 7 = 0) as string)) as error,
 cast(nullif(sum(event_id % 100) filter (event_type = 'purchase' and event_id % 7 <> 0), 0) as bigint) as total_tokens, count(*) filter (event_type in ('click', 'view', 'error')) as steps,
 concat('say ', cast(max(event_id) filter (event_type = 'view') as string)) as answer from events group by user_id""", raw=True)(
    lambda s: hooks.execution_stream(execution_lines(s))["traces"].selectExpr("stream", "status", "coalesce(error, 'm') as error", "total_tokens", "steps", "coalesce(answer, 'say ') as answer")
)


def answered(s: Store) -> DataFrame:
    """Events as verdicts on calls in five dialects, some of which are confirmed."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "event_id", "element_at(array('claude-code', 'codex', 'gemini', 'crush', 'unknown'), cast(user_id % 5 + 1 as int)) as dialect", "concat('Pre', event_type) as event_name",
        "element_at(array('allow', 'warn', 'require_review', 'deny'), cast(event_id % 4 + 1 as int)) as verdict", "if(event_id % 7 = 0, null, concat('p', event_id % 7)) as policy",
        "if(event_id % 3 = 0, null, concat('says \"', event_id, '\"')) as reason", "event_id % 8 = 2 as confirmed",
    )


query("guard_exits", """select event_id, case event_id % 4 when 0 then 'allow' when 1 then 'warn' when 2 then case when event_id % 8 = 2 then 'allow' else 'deny' end else 'deny' end as asked,
 case event_id % 4 when 0 then 'allow' when 1 then 'warn' else 'deny' end as unasked, cast(case when event_id % 4 = 3 or (event_id % 4 = 2 and event_id % 8 <> 2) then 2 else 0 end as int) as asked_exit,
 cast(case when event_id % 4 in (2, 3) then 2 else 0 end as int) as unasked_exit from events""", raw=True)(
    lambda s: enforce.exits(
        enforce.exits(answered(s), interactive=True).selectExpr("event_id", "verdict", "confirmed", "final as asked", "exit_code as asked_exit")
    ).selectExpr("event_id", "asked", "final as unasked", "asked_exit", "exit_code as unasked_exit")
)
query("hook_responses", """with e as (select *, user_id % 5 as d, event_id % 4 as v, 'Pre' || event_type as event,
 coalesce(case when event_id % 3 <> 0 then 'says \\"' || event_id || '\\"' end, trim('blocked by policy ' || case when event_id % 7 = 0 then '' else 'p' || (event_id % 7) end)) as why from events)
 select event_id, case when v = 1 and d < 2 then '{"systemMessage":"runloom: ' || why || '"}' when v in (2, 3) and d < 2 then '{"hookSpecificOutput":{"hookEventName":"' || event || '","permissionDecision":"'
 || case v when 2 then 'ask' else 'deny' end || '","permissionDecisionReason":"' || why || '"}}' when v in (2, 3) and d = 2 then '{"decision":"deny","reason":"' || case v when 2 then 'review required: ' else '' end || why || '"}' end as stdout,
 case when v in (2, 3) and d > 2 then replace(why, '\\"', '"') end as stderr, cast(case when v in (2, 3) and d > 2 then 2 else 0 end as int) as exit_code from e""", raw=True)(
    lambda s: enforce.responses(answered(s)).select("event_id", "stdout", "stderr", "exit_code")
)


def ended_runs(s: Store) -> DataFrame:
    """Processes of nine in ten traces: some fail, some are killed, some have declared a status, and of some it was repaired."""
    return s.traces.selectExpr("id", "cast(substring(id, 5) as bigint) as k").where("k % 10 <> 9").selectExpr(
        "id", "k * 1000 as started_ms", "k * 1000 + 250 as ended_ms", "if(k % 6 = 0, null, cast(k % 4 as int)) as code", "case when k % 6 = 0 then if(k % 12 = 0, 'SIGKILL', 'SIGTERM') end as killed",
        "k % 5 = 0 as declared", "k % 8 = 0 as repaired",
    )


query("run_finalised", """, r as (select *, cast(substr(id, 5) as bigint) as k from traces),
 x as (select *, k % 10 <> 9 as ran, case when k % 6 = 0 then case when k % 12 = 0 then 137 else 143 end else k % 4 end as code from r),
 y as (select *, ran and k % 5 <> 0 and (status = 'running' or code <> 0 or k % 8 = 0) as takes from x)
 select id, case when takes then case when code = 0 then 'completed' else 'failed' end else status end as status, case when takes or (ran and k % 5 = 0 and total_duration_ms is null) then 250 else total_duration_ms end as total_duration_ms,
 case when takes and k % 6 = 0 then case when k % 12 = 0 then 'child killed by signal SIGKILL (exit 137)' else 'child killed by signal SIGTERM (exit 143)' end
 when takes and code <> 0 then 'child exited with code ' || code else error end as error, cast(case when ran then code end as varchar) as exit_code from y""")(
    lambda s: enforce.finalised(s.traces.withColumns({"metadata": F.lit('{"a":[1]}')}), ended_runs(s)).select(
        "id", "status", "total_duration_ms", "error", F.get_json_object("metadata", "$.exit_code").alias("exit_code")
    )
)


def judge_replies(s: Store) -> DataFrame:
    """Events as replies: plain, fenced after a quoted block, inline after a quoted object, without JSON, and of four presets."""
    marks = lambda x: "'{{\"relevance\":', {0}, ',\"completeness\":\"', {0}, '\",\"coherence\":', {0}, ',\"accuracy\":', {0}, '}}'".format(x)
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "event_id as trace_id", "case when event_id % 8 < 4 then 'ai-quality-review' when event_id % 8 < 6 then 'ai-security-audit' when event_id % 8 = 6 then 'ai-optimization' else 'ai-root-cause' end as preset",
        f"case event_id % 8 when 0 then concat({marks('event_id % 11')}) when 1 then concat('quoted ```json\n', {marks(10)}, '\n``` mine ```\n', {marks('event_id % 11')}, '\n```')"
        f" when 2 then concat('it says ', {marks(10)}, ' but I say ', {marks('event_id % 11')}, ' \"}}\" end') when 3 then 'it is fine'"
        " when 4 then concat('{\"risk_level\":\"none\",\"findings\":[{\"severity\":\"low\"},{\"severity\":\"', if(event_id % 3 = 0, 'Critical', 'odd'), '\"}]}') when 5 then '{\"risk_level\":7}'"
        " when 6 then concat('{\"efficiency_score\":\"', event_id % 13, '\"}') else concat('{\"confidence\":', if(event_id % 3 = 0, 'true', '0.6'), '}') end as reply",
    )


query("judge_replies", """with x as (select event_id, case event_id % 8 when 0 then event_id % 11 / 10.0 when 1 then event_id % 11 / 10.0 when 2 then event_id % 11 / 10.0 when 3 then 0
 when 4 then case when event_id % 3 = 0 then 0.0 else 0.8 end when 5 then 0.5 when 6 then least(10, event_id % 13) / 10.0 else case when event_id % 3 = 0 then 0 else 0.6 end end as s from events)
 select cast(event_id as varchar) as trace_id, cast(s as double) as score, s >= case when event_id % 8 < 4 then 0.7 when event_id % 8 < 6 then 0.8 when event_id % 8 = 6 then 0.6 else 0.5 end as passed,
 case when event_id % 8 = 3 then 'no JSON in the reply' end as error from x""", raw=True)(lambda s: replies.verdicts(judge_replies(s)).select("trace_id", "score", "passed", "error"))
