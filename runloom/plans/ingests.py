"""Named queries over what is ingested: validation, events, transcripts and rollouts, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports, validate
from ..sources.fixtures import ORDER, Store, table
from .queries import query


def documents(s: Store) -> DataFrame:
    """Orders as traces in JSON with their line items as steps, with faults planted by key."""
    lines = table(s.spark, s.sf_dir, "lineitem").selectExpr(
        "l_orderkey", f"struct({ORDER}, l_linenumber as step_number, if(l_partkey % 50 = 0, 'bogus', 'tool_call') as step_type, if(l_partkey % 50 = 1, '', 'look') as name,"
        " if(l_partkey % 50 = 2, -5, 7) as tokens_used, case when l_suppkey % 20 = 0 then l_linenumber when l_linenumber > 1 and l_suppkey % 20 = 1 then 99 end as parent_step,"
        " named_struct('part', l_partkey) as input, case when l_partkey % 50 in (3, 4) then named_struct('chosen', if(l_partkey % 50 = 3, '', 'x'), 'confidence', l_suppkey % 12 / 10.0) end as decision) as x",
    )
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("steps"))
    return table(s.spark, s.sf_dir, "orders").join(steps, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "o_orderkey as doc_id", "to_json(named_struct('id', concat('trc_', o_orderkey), 'agent_name', if(o_orderkey % 10 = 0, null, 'a'), 'status', if(o_orderkey % 10 = 1, 'odd', null),"
        " 'ended_at', if(o_orderkey % 10 = 3, '2020-01-01T00:00:00Z', null), 'total_tokens', if(o_orderkey % 10 = 2, -1, 5), 'tags', array('x'),"
        " 'steps', transform(steps, s -> named_struct('step_number', s.step_number, 'step_type', s.step_type, 'name', s.name, 'tokens_used', s.tokens_used,"
        " 'parent_step', s.parent_step, 'input', s.input, 'decision', s.decision)))) as body",
    )


FAULTS = f"""with l as (select *, row_number() over (partition by l_orderkey order by {ORDER}) - 1 as i, count(*) over (partition by l_orderkey, l_linenumber) as same from lineitem),
 faults as (select o_orderkey as doc_id, 'agent_name' as field, 'is required and must be a string' as message from orders where o_orderkey % 10 = 0
 union all select o_orderkey, 'status', 'is unknown' from orders where o_orderkey % 10 = 1
 union all select o_orderkey, 'total_tokens', 'must be a finite number of 0 or more' from orders where o_orderkey % 10 = 2
 union all select distinct l_orderkey, 'steps', 'a step_number appears more than once' from l where same > 1
 union all select l_orderkey, 'steps[' || i || '].step_type', 'is required and must be known' from l where l_partkey % 50 = 0
 union all select l_orderkey, 'steps[' || i || '].name', 'is required and must be a string' from l where l_partkey % 50 = 1
 union all select l_orderkey, 'steps[' || i || '].tokens_used', 'must be a finite number of 0 or more' from l where l_partkey % 50 = 2
 union all select l_orderkey, 'steps[' || i || '].parent_step', 'must name an earlier step' from l where l_suppkey % 20 = 0 or (l_suppkey % 20 = 1 and l_linenumber > 1)
 union all select l_orderkey, 'steps[' || i || '].parent_step', 'names a step that is not there' from l where l_suppkey % 20 = 1 and l_linenumber > 1
 union all select l_orderkey, 'steps[' || i || '].decision.chosen', 'is required and must be a string' from l where l_partkey % 50 = 3
 union all select l_orderkey, 'steps[' || i || '].decision.confidence', 'must be a number from 0 to 1' from l where l_partkey % 50 in (3, 4) and l_suppkey % 12 = 11)
"""
query("validate_traces", f"{FAULTS} select * from faults", raw=True)(lambda s: validate.validate(documents(s)))
query("ingest_traces", f"""{FAULTS}, good as (select * from orders where o_orderkey not in (select doc_id from faults))
 select concat('trc_', cast(o_orderkey as string)) as id, case when o_orderkey % 10 = 3 then 'completed' else 'running' end as status, 'x,extra' as tags,
 (select count(*) from l where l_orderkey = o_orderkey) as steps, (select count(*) from l where l_orderkey = o_orderkey and l_partkey % 50 = 4) as decisions,
 (select string_agg(concat('{{"part":', cast(l_partkey as string), '}}'), '' order by l_linenumber) from l where l_orderkey = o_orderkey) as inputs from good""", raw=True)(
    lambda s: (lambda t: t["traces"].select("id", "status", F.array_join("tags", ",").alias("tags")).join(
        t["steps"].groupBy(F.col("trace_id").alias("id")).agg(F.count("*").alias("steps"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_number", "input"))), lambda x: x["input"]), "").alias("inputs")), "id", "left"
    ).join(t["decisions"].groupBy(F.col("trace_id").alias("id")).agg(F.count("*").alias("decisions")), "id", "left").select(
        "id", "status", "tags", "inputs", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("steps", "decisions"))))(validate.tables(documents(s), ["extra"]))
)


def capture_lines(s: Store) -> DataFrame:
    """Events as lines of a capture stream, some of which can't be used."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "event_id as seq", "case when event_id % 97 = 0 then '[]' when event_id % 89 = 0 then 'no json' else to_json(named_struct('v', if(event_id % 83 = 0, 2, null),"
        " 'type', case event_type when 'click' then 'step_start' when 'view' then 'step_end' when 'signup' then 'trace_start' when 'error' then 'decision' else 'trace_end' end,"
        " 'agent_name', if(event_type = 'signup', 'a', null), 'trace_id', cast(user_id as string), 'step_number', if(event_type in ('click', 'view', 'error'), event_id % 24 + 1, null),"
        " 'step_type', if(event_type = 'click', 'tool_call', null), 'name', if(event_type = 'click', concat('n', event_id), null),"
        " 'output', if(event_type = 'view', named_struct('n', event_id), null), 'tokens_used', if(event_type = 'view', if(event_id % 11 = 0, -1, event_id % 50), null),"
        " 'parent_step', if(event_type = 'click', event_id % 24 + if(event_id % 5 = 0, 1, 0), null), 'chosen', if(event_type = 'error', concat('c', event_id), null),"
        " 'confidence', if(event_type = 'error', event_id % 13 / 10.0, null), 'status', if(event_type = 'purchase', if(event_id % 3 = 0, ' Done', 'odd'), null))) end as line",
    )


EVENTS = """with e as (select event_id as seq, cast(user_id as string) as u, case event_type when 'click' then 'step_start' when 'view' then 'step_end' when 'signup' then 'trace_start'
 when 'error' then 'decision' else 'trace_end' end as t, event_id % 24 + 1 as n from events),
 r as (select *, case when seq % 97 = 0 or seq % 89 = 0 then 'skipped: must be an object' when seq % 83 = 0 then 'skipped: unsupported version'
 when t = 'decision' and seq % 13 > 10 then 'skipped: confidence must lie in 0 to 1' end as skip, t = 'trace_end' and seq % 3 <> 0 as odd,
 case when t = 'step_end' and seq % 11 = 0 then 'ignored tokens_used' when t = 'step_start' and (seq % 5 = 0 or n = 1) then 'ignored parent_step' end as out from e)
"""
query("event_validation", f"""{EVENTS} select seq, case when not (seq % 97 = 0 or seq % 89 = 0) then t end as type, skip is null as used,
 case when skip is null and t = 'trace_end' then case when odd then 'failed' else 'completed' end end as status, skip is null and odd as repaired,
 coalesce(skip, nullif(concat_ws('; ', case when odd then 'status is recorded as failed' when t = 'trace_end' then 'status is read as completed' end, out), '')) as warning from r""", raw=True)(
    lambda s: validate.read_events(capture_lines(s)).selectExpr("seq", "type", "event is not null as used", "status", "coalesce(repaired, false) as repaired", "warning")
)
FOLD = f"""{EVENTS}, k as (select *, bool_or(t = 'trace_start') over (partition by u order by seq rows unbounded preceding) as began,
 coalesce(bool_or(t = 'trace_end') over (partition by u order by seq rows between unbounded preceding and 1 preceding), false) as ended from r where skip is null),
 g as (select * from k where began), f as (select u, n, min(seq) as first from g where t = 'step_start' and not ended group by 1, 2)
"""
query("event_fold_steps", f"""{FOLD} select g.u as trace_id, g.n as step_number, max(case when t = 'step_start' then concat('n', cast(seq as string)) end) as name,
 arg_max(concat('{{"n":', cast(seq as string), '}}'), seq) filter (t = 'step_end') as output, arg_max(seq % 50, seq) filter (t = 'step_end' and out is null) as tokens_used,
 max(case when t = 'step_start' and out is null then g.n - 1 end) as parent_step_number from g join f on f.u = g.u and f.n = g.n
 where (t = 'step_start' and seq = first) or (t = 'step_end' and seq > first) group by 1, 2""", raw=True)(
    lambda s: validate.fold(validate.read_events(capture_lines(s)))["steps"].select("trace_id", "step_number", "name", "output", "tokens_used", "parent_step_number")
)
query("event_fold_decisions", f"""{FOLD} select g.u as trace_id, g.n as step_number, arg_max(concat('c', cast(seq as string)), seq) as chosen from g join f on f.u = g.u and f.n = g.n
 where t = 'decision' and seq > first group by 1, 2""", raw=True)(
    lambda s: validate.fold(validate.read_events(capture_lines(s)))["decisions"].select("trace_id", "step_number", "chosen")
)
query("event_fold_traces", f"""{FOLD} select u as trace_id, 'a' as agent_name, coalesce(arg_max(case when odd then 'failed' else 'completed' end, seq) filter (t = 'trace_end'), 'timeout') as status
 from g left join (select distinct u as fu, n as fn, first from f) f on fu = u and fn = n and t in ('step_end', 'decision') group by 1""", raw=True)(
    lambda s: validate.fold(validate.read_events(capture_lines(s)))["traces"].select("trace_id", "agent_name", "status")
)


def transcript_lines(s: Store) -> DataFrame:
    """Conversations as transcripts: an assistant's turn says something and calls a tool, a user's answers the call before it. A third of the
    sessions have a line that is no record."""
    rows = table(s.spark, s.sf_dir, "conversations").selectExpr(
        "concat('f', conv_id) as file", "cast(turn + 1 as int) as n",
        "to_json(named_struct('type', role, 'sessionId', concat('s', conv_id), 'timestamp', concat('2024-01-01T00:00:', lpad(cast(turn as string), 2, '0'), 'Z'), 'message', named_struct('role', role,"
        " 'content', if(role = 'assistant', array(named_struct('type', 'text', 'text', text, 'id', cast(null as string), 'name', cast(null as string), 'tool_use_id', cast(null as string), 'content', cast(null as string), 'is_error', cast(null as boolean)),"
        " named_struct('type', 'tool_use', 'text', null, 'id', concat('t', turn), 'name', 'lookup', 'tool_use_id', null, 'content', null, 'is_error', null)),"
        " array(named_struct('type', 'tool_result', 'text', null, 'id', null, 'name', null, 'tool_use_id', concat('t', turn - 1), 'content', concat('r', turn), 'is_error', turn % 3 = 0),"
        " named_struct('type', 'text', 'text', text, 'id', null, 'name', null, 'tool_use_id', null, 'content', null, 'is_error', null))),"
        " 'usage', named_struct('input_tokens', turn + 1, 'output_tokens', 2, 'cache_creation_input_tokens', -4, 'cache_read_input_tokens', '3')))) as line",
    )
    bad = rows.where("n = 1 and substr(file, 2) % 3 = 0").selectExpr("file", "1000 as n", "'no json' as line")
    return rows.union(bad)


TALK = """with c as (select *, lag(role) over (partition by conv_id order by turn) as before, lead(role) over (partition by conv_id order by turn) as after,
 lag(turn) over (partition by conv_id order by turn) as t1, lead(turn) over (partition by conv_id order by turn) as t2 from conversations)"""
query("import_transcripts", f"""{TALK} select concat('f', cast(conv_id as string)) as file, concat('s', cast(conv_id as string)) as session_id, arg_min(text, turn) filter (role = 'user') as prompt,
 arg_max(text, turn) filter (role = 'assistant') as answer, cast(sum(case when role in ('user', 'assistant') then turn + 6 else 0 end) as bigint) as total_tokens,
 2 * count(*) filter (role = 'assistant') as steps, count(*) filter (role in ('user', 'assistant')) as imported,
 count(*) filter (role = 'system') + case when conv_id % 3 = 0 then 1 else 0 end as skipped from c group by conv_id having count(*) filter (role in ('user', 'assistant')) > 0""", raw=True)(
    lambda s: imports.transcripts(transcript_lines(s))["traces"].select("file", "session_id", "prompt", "answer", "total_tokens", "steps", "imported", "skipped")
)
query("transcript_steps", f"""{TALK} select concat('f', cast(conv_id as string)) as file, cast(2 * row_number() over (partition by conv_id order by turn) - 1 + k as int) as step_number,
 case k when 0 then 'output' else 'tool_call' end as step_type, case k when 0 then 'assistant_message' else 'lookup' end as name,
 case when k = 1 and after in ('user', 'system') and t2 = turn + 1 and after = 'user' and t2 % 3 = 0 then concat('r', cast(t2 as string)) end as error,
 case when k = 1 and after = 'user' and t2 = turn + 1 then concat('r', cast(t2 as string)) when k = 0 then text end as said
 from (select * from c where role = 'assistant') x cross join (values (0), (1)) v(k)""".replace("cast(2 * row_number() over (partition by conv_id order by turn) - 1 + k as int)", "cast(row_number() over (partition by conv_id order by turn, k) as int)"), raw=True)(
    lambda s: imports.transcripts(transcript_lines(s))["steps"].selectExpr(
        "file", "step_number", "step_type", "name", "error", "coalesce(get_json_object(output, '$.result'), get_json_object(output, '$.text')) as said"
    )
)


def rollout_lines(s: Store) -> DataFrame:
    """Events as rollouts, a user a file; calls and outputs share ids again and again."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "concat('u', user_id) as file", "cast(event_id as int) as n",
        "to_json(named_struct('type', 'response_item', 'timestamp', concat('t', event_id), 'payload', named_struct("
        " 'type', case event_type when 'click' then 'function_call' when 'view' then 'function_call_output' when 'error' then 'reasoning' when 'signup' then 'message' else 'token_count' end,"
        " 'role', if(event_type = 'signup', if(event_id % 2 = 0, 'user', 'assistant'), null), 'content', if(event_type = 'signup', array(named_struct('type', 'text', 'text', concat('said ', event_id))), null),"
        " 'call_id', if(event_type in ('click', 'view'), event_id % 50, null), 'name', if(event_type = 'click', 'run', null), 'arguments', if(event_type = 'click', '{\"a\":1}', null),"
        " 'output', if(event_type = 'view', if(event_id % 4 = 0, concat('{\"metadata\":{\"exit_code\":2},\"output\":\"', event_id, '\"}'), concat('fine ', event_id)), null),"
        " 'summary', if(event_type = 'error', array(named_struct('text', concat('think ', event_id))), null),"
        " 'info', if(event_type = 'purchase', named_struct('total_token_usage', named_struct('total_tokens', event_id * 10)), null)))) as line",
    )


ROLL = """with o as (select user_id, event_id % 50 as call, max(event_id) as last from events where event_type = 'view' group by 1, 2),
 k as (select e.*, case when event_type = 'click' then last end as last from events e left join o on o.user_id = e.user_id and o.call = e.event_id % 50)"""
query("import_rollouts", f"""{ROLL} select concat('u', cast(user_id as string)) as file, max(event_id) filter (event_type = 'purchase') * 10 as total_tokens,
 concat('said ', cast(min(event_id) filter (event_type = 'signup' and event_id % 2 = 0) as string)) as prompt,
 concat('said ', cast(max(event_id) filter (event_type = 'signup' and event_id % 2 = 1) as string)) as answer,
 count(*) filter (event_type in ('click', 'error') or (event_type = 'signup' and event_id % 2 = 1)) as steps,
 count(*) filter (event_type <> 'view') + count(*) filter (event_type = 'view' and exists (select 1 from events c where c.user_id = k.user_id and c.event_type = 'click' and c.event_id % 50 = k.event_id % 50)) as imported
 from k group by user_id""", raw=True)(
    lambda s: imports.rollouts(rollout_lines(s))["traces"].select("file", "total_tokens", F.coalesce("prompt", F.lit("said ")).alias("prompt"), F.coalesce("answer", F.lit("said ")).alias("answer"), "steps", "imported")
)
query("rollout_steps", f"""{ROLL} select concat('u', cast(user_id as string)) as file, cast(row_number() over (partition by user_id order by event_id) as int) as step_number,
 case event_type when 'click' then 'tool_call' when 'error' then 'thought' else 'output' end as step_type, case event_type when 'click' then 'run' when 'error' then 'reasoning' else 'assistant_message' end as name,
 case when last % 4 = 0 then 'exited with code 2' end as error, case when event_type = 'click' and last % 4 <> 0 then concat('fine ', cast(last as string))
 when event_type = 'error' then concat('think ', cast(event_id as string)) when event_type = 'signup' then concat('said ', cast(event_id as string)) end as said
 from k where event_type in ('click', 'error') or (event_type = 'signup' and event_id % 2 = 1)""", raw=True)(
    lambda s: imports.rollouts(rollout_lines(s))["steps"].selectExpr(
        "file", "step_number", "step_type", "name", "error",
        "case when error is null then coalesce(get_json_object(output, '$.output'), get_json_object(output, '$.text')) end as said"
    )
)
