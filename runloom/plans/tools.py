"""Named queries over streams of tool lines; their oracles read each stream line by line in a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import tool_streams
from ..sources.fixtures import Store, table
from .queries import query


def tool_lines(s: Store) -> DataFrame:
    """Events as tool lines, a stream a user: calls and results with ids, with names, with neither, or with a mix that only the order decides; messages and ends."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "concat('u', user_id) as stream", "event_id as n",
        "to_json(named_struct('type', case when event_type in ('click', 'purchase') then 'tool_use' when event_type in ('view', 'error') then 'tool_result' when event_id % 4 < 2 then 'message'"
        " when event_id % 4 = 2 then 'odd' when event_id % 16 = 3 then 'result' when event_id % 16 = 7 and user_id % 10 = 3 then 'error' else 'init' end,"
        " 'id', if(user_id % 4 = 0 or (user_id % 4 = 3 and event_id % 2 = 0), concat('c', event_id % 3), null),"
        " 'name', if(user_id % 4 in (0, 1) or (user_id % 4 = 3 and event_id % 3 > 0), concat('t', event_id % 2), null), 'output', if(event_type in ('view', 'error'), concat('o', event_id), null),"
        " 'text', concat('say ', event_id), 'message', concat('m', event_id), 'is_error', event_type = 'error', 'usage', named_struct('input_tokens', event_id % 50, 'output_tokens', 1), 'exit_code', if(event_id % 32 = 3, 1, 0))) as line",
    )


LINES = """with recursive e as (select 'u' || user_id as stream, event_id as n, user_id, event_type, case when event_type in ('click', 'purchase') then 'tool_use' when event_type in ('view', 'error') then 'tool_result'
 when event_id % 4 < 2 then 'message' when event_id % 4 = 2 then 'odd' when event_id % 16 = 3 then 'result' when event_id % 16 = 7 and user_id % 10 = 3 then 'error' else 'init' end as type,
 case when user_id % 4 = 0 or (user_id % 4 = 3 and event_id % 2 = 0) then 'c' || (event_id % 3) end as call,
 case when user_id % 4 in (0, 1) or (user_id % 4 = 3 and event_id % 3 > 0) then 't' || (event_id % 2) end as name from events),
 l as (select *, row_number() over (partition by stream order by n) as k from e where type in ('tool_use', 'tool_result')),
 r as (select stream, cast(0 as bigint) as k, cast([] as struct(n bigint, call varchar, name varchar)[]) as open, cast(null as bigint) as open_n, cast(null as bigint) as close_n from l where k = 1
 union all select stream, k, case when type = 'tool_use' then list_append(list_transform(open, lambda x: {'n': x.n, 'call': case when x.call = call then null else x.call end, 'name': x.name}), {'n': n, 'call': call, 'name': coalesce(name, 'tool')})
 else list_filter(open, lambda x: hit is null or x.n <> hit) end, hit, case when hit is not null then n end from (select l.*, r.open, case when type = 'tool_result' then coalesce(
 list_filter(r.open, lambda x: coalesce(x.call = l.call, false))[1].n, list_filter(r.open, lambda x: l.name is null or x.name = l.name)[1].n) end as hit from r join l on l.stream = r.stream and l.k = r.k + 1)),
 pair as (select stream, open_n, close_n from r where close_n is not null)
"""
query("tool_stream_pairs", LINES + "select * from pair", raw=True)(lambda s: tool_streams.pairs(tool_lines(s)))
query("tool_stream_steps", LINES + """select e.stream, cast(row_number() over (partition by e.stream order by e.n) as int) as step_number, case e.type when 'message' then 'output' else 'tool_call' end as step_type,
 case e.type when 'message' then 'message' else coalesce(e.name, 'tool') end as name, case e.type when 'message' then '{"text":"say ' || e.n || '"}' else '{"output":"o' || close_n || '"}' end as output,
 case when d.event_type = 'error' then 'o' || close_n end as error from e left join pair p on p.stream = e.stream and p.open_n = e.n left join e d on d.stream = p.stream and d.n = p.close_n where e.type in ('tool_use', 'message')""", raw=True)(
    lambda s: tool_streams.tool_stream(tool_lines(s))["steps"].select("stream", "step_number", "step_type", "name", "output", "error")
)
query("tool_stream_traces", LINES + """, f as (select stream, min(n) as start from e where type in ('init', 'tool_use', 'message') group by 1),
 s as (select f.stream, min(n) as stop from f join e on e.stream = f.stream and type = 'result' and n > start group by 1),
 x as (select e.*, start, stop from e join f on f.stream = e.stream left join s on s.stream = e.stream), y as (select stream, max(n) filter (type = 'error' and (stop is null or n <= stop)) as err,
 min(n) filter (type = 'result' and n % 32 = 3 and (stop is null or n <= stop)) as bad, coalesce(bool_or(type = 'result' and (stop is null or n <= stop)), false) as ended,
 cast(nullif(sum(case when type = 'result' and (stop is null or n <= stop) then n % 50 + 1 else 0 end), 0) as bigint) as total_tokens,
 max(n) filter (type = 'message' and (stop is null or n <= stop)) as said, count(*) filter (type in ('tool_use', 'message')) as steps from x group by 1)
 select stream, case when err is not null or bad is not null then 'failed' when ended then 'completed' else 'timeout' end as status, case when err is not null then 'm' || err when bad is not null then 'exited with code 1' end as error,
 total_tokens, 'say ' || said as answer, steps from y""", raw=True)(lambda s: tool_streams.tool_stream(tool_lines(s))["traces"])
query("tool_stream_skipped", LINES + """select stream, n, type, 'unknown type' as reason from e where type = 'odd'
 union all select stream, n, type, 'no open call' from e where type = 'tool_result' and not exists (select 1 from pair p where p.stream = e.stream and p.close_n = e.n)""", raw=True)(
    lambda s: tool_streams.tool_stream(tool_lines(s))["skipped"]
)
