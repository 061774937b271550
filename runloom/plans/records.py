"""Named queries over records beside the traces, exports and scalar functions, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, times
from ..operators import browse, compare, export, graph, records
from ..sources.fixtures import Store, table
from .queries import SINCE, eff, query

query("step_decisions", """select s.trace_id, s.step_number, step_type, chosen, rationale, round(confidence, 3) as confidence, decided_by from steps s
 left join decisions d on d.trace_id = s.trace_id and d.step_number = s.step_number""")(
    lambda s: records.with_decisions(s.steps, s.records("decisions")).selectExpr(
        "trace_id", "step_number", "step_type", "chosen", "rationale", "round(confidence, 3) as confidence", "decided_by"
    )
)
query("decision_records", """select s.trace_id, s.step_number, chosen from steps s left join decisions d on d.trace_id = s.trace_id and d.step_number = s.step_number
 where step_type = 'decision' or chosen is not null""")(
    lambda s: records.decision_points(s.steps, s.records("decisions")).select("trace_id", "step_number", "chosen")
)
query("step_snapshots", """select s.trace_id, s.step_number, name, context_window, token_count from steps s join snapshots d on d.trace_id = s.trace_id
 and d.step_number = s.step_number""")(
    lambda s: records.with_snapshots(s.steps, s.records("snapshots")).select("trace_id", "step_number", "name", "context_window", "token_count")
)
query("replaced_decisions", """select trace_id, step_number, case when step_number % 2 = 0 then 'replaced' else chosen end as chosen from decisions""")(
    lambda s: records.attached(
        (d := s.records("decisions").select("trace_id", "step_number", "chosen", F.lit(1).alias("seq"))).union(
            d.where("step_number % 2 = 0").selectExpr("trace_id", "step_number", "'replaced'", "2")
        )
    ).drop("seq")
)
query("evals_newest", """select trace_id, seq, evaluator_name, row_number() over (partition by trace_id order by evaluated_ms desc, seq desc) as rank from
 (select * from evals union all select trace_id, evaluator_type, 'again', score, passed, details, evaluated_ms, seq + 1 from evals where seq % 2 = 0) e""")(
    lambda s: records.newest_evals(
        (e := s.records("evals")).union(e.where("seq % 2 = 0").withColumn("evaluator_name", F.lit("again")).withColumn("seq", F.col("seq") + 1))
    ).select("trace_id", "seq", "evaluator_name", "rank")
)
_MEASURED = "coalesce(json_extract_string(details, '$.skipped'), 'false') <> 'true'"
query("recent_scores", f"""select row_number() over (order by evaluated_ms, seq) as place, trace_id, score, passed from
 (select * from evals where {_MEASURED} order by evaluated_ms desc, seq desc limit 20) e""")(lambda s: records.recent_scores(s.records("evals")))
query("eval_totals", f"""select evaluator_name, count(*) filter ({_MEASURED} and passed) as passed, count(*) filter ({_MEASURED} and not passed) as failed,
 count(*) filter (not {_MEASURED}) as skipped, round(avg(score) filter ({_MEASURED}), 6) as avg_score from evals group by 1""")(
    lambda s: records.eval_totals(s.records("evals"))
)
query("store_counts", f"""select count(*) as traces, cast(sum(step_count) as bigint) as steps, cast(round(avg(duration_ms)) as bigint) as avg_duration_ms,
 count(duration_ms) as measured, cast(sum(effective_tokens) as bigint) as tokens, round(sum(total_cost_usd), 2) as cost_usd,
 (select count(*) from evals where trace_id in (select id from traces where parent_trace_id is null and started_ms >= {SINCE})) as evals, 3 as policies
 from eff where parent_trace_id is null and started_ms >= {SINCE}""")(
    lambda s: browse.store_counts(browse.TraceFilter(since_ms=SINCE).apply(eff(s)), s.records("evals"), 3)
)
query("windowed_children", f"""select e.trace_id, seq from evals e where trace_id in (select id from traces where started_ms >= {SINCE})""")(
    lambda s: records.children_of(browse.TraceFilter(since_ms=SINCE).apply(s.traces), s.records("evals")).select("trace_id", "seq")
)
query("next_step_number", "select trace_id, max(step_number) + 1 as next_number from steps group by 1")(lambda s: records.next_step_number(s.steps))
query("metadata_path", "select id from traces where json_extract_string(metadata, '$.source_file') = 'f3'")(
    lambda s: records.by_metadata(s.traces, "source_file", "f3").select("id")
)
query("metadata_missing", "select id from traces where json_extract_string(metadata, '$.source_file') is null")(
    lambda s: records.by_metadata(s.traces, "source_file", None).select("id")
)
query("comparable_candidates", "select id, status from traces where parent_trace_id is null and status <> 'running'")(
    lambda s: compare.comparable(s.traces)[0].select("id", "status")
)
query("page_with_total", "select id, (select count(*) from traces where status = 'failed') as total from traces where status = 'failed' order by id limit 25")(
    lambda s: export.counted_page(s.traces.where("status = 'failed'").select("id"), [F.col("id")])
)
query("shown_steps", "select trace_id, count(*) filter (step_number between 2 and 3) as shown, count(*) filter (step_number not between 2 and 3) as omitted from steps group by 1")(
    lambda s: export.step_window(s.steps, 2, 3)
)
query("tag_membership", "select id from traces where tag = '1-urgent' or trace_key % 7 = 0")(
    lambda s: browse.TraceFilter(tag="1-urgent").apply(
        s.traces.withColumn("tags", F.expr("case when trace_key % 7 = 0 then array('1-urgent', tag) else array('prod', tag) end")).drop("tag")
    ).select("id")
)
query("deleted_traces", """select t.id, case when p.status = 'failed' then null else t.parent_trace_id end as parent_trace_id,
 (select count(*) from steps s where s.trace_id = t.id) as steps from traces t left join traces p on p.id = t.parent_trace_id where t.status <> 'failed'""")(
    lambda s: (lambda d: d["traces"].select("id", "parent_trace_id").join(
        d["steps"].groupBy("trace_id").agg(F.count("*").alias("n")), F.expr("id = trace_id"), "left"
    ).select("id", "parent_trace_id", F.coalesce("n", F.lit(0)).alias("steps")))(
        records.delete({"traces": s.traces, "steps": s.steps, "evals": s.records("evals")}, s.traces.where("status = 'failed'").select("id"))
    )
)


def exported(s: Store) -> DataFrame:
    return export.export_rows(s.traces, s.steps, s.records("decisions"), s.records("evals"), s.records("snapshots"))


def _get(*paths: str) -> list[str]:
    return [f"get_json_object(json, '$.{p}') as {n}" for p, n in (x.split(":") for x in paths)]


query("export_traces", """select t.id, t.agent_name, t.error, t.input, coalesce(n, 0) as steps, coalesce(names, '') as names, s1.chosen, s1.token_count, coalesce(e, 0) as evals
 from traces t left join (select trace_id, count(*) as n, string_agg(name, ',' order by step_number) as names from steps group by 1) s on s.trace_id = t.id
 left join (select s.trace_id, chosen, token_count from steps s left join decisions d on d.trace_id = s.trace_id and d.step_number = s.step_number
 left join snapshots p on p.trace_id = s.trace_id and p.step_number = s.step_number where s.step_number = 1) s1 on s1.trace_id = t.id
 left join (select trace_id, count(*) as e from evals group by 1) v on v.trace_id = t.id""")(
    lambda s: exported(s).selectExpr(
        "from_json(json, 'id string, agent_name string, error string, input string, steps array<struct<name: string, decision: struct<chosen: string>,"
        " snapshot: struct<token_count: bigint>>>, evals array<struct<passed: boolean>>') as x"
    ).selectExpr(
        "x.id", "x.agent_name", "x.error", "x.input", "size(x.steps) as steps", "array_join(x.steps.name, ',') as names", "get(x.steps, 0).decision.chosen as chosen",
        "get(x.steps, 0).snapshot.token_count as token_count", "size(x.evals) as evals",
    )
)
query("export_reimport", """select (select count(*) from traces) as traces, (select count(*) from steps) as steps, (select count(*) from evals) as evals,
 (select count(*) from traces where parent_trace_id is not null) as forks""")(lambda s: export.reimported(exported(s)))
query("golden_export", f"""select t.id, coalesce(n, 0) as steps, inputs, models, failures, coalesce(c, 0) as criteria, t.status, coalesce(tag, '') as tag,
 case when t.metadata = '{{}}' then null else json_extract_string(t.metadata, '$.source_file') end as source_file, t.total_tokens
 from traces t left join (select trace_id, count(*) as n, string_agg(case when step_type = 'tool_call' then input end, ';' order by step_number) as inputs,
 string_agg(model, ',' order by step_number) as models, count(error) as failures from steps group by 1) s on s.trace_id = t.id
 left join (select trace_id, count(*) as c from evals where {_MEASURED} group by 1) e on e.trace_id = t.id where parent_trace_id is null""")(
    lambda s: export.golden_rows(s.traces, s.steps, s.records("evals")).selectExpr(
        "id", "size(steps_summary) as steps", "nullif(array_join(transform(steps_summary, x -> x.input), ';'), '') as inputs",
        "nullif(array_join(transform(steps_summary, x -> x.model), ','), '') as models",
        "case when size(steps_summary) > 0 then size(filter(steps_summary, x -> x.failed)) end as failures", "size(eval_criteria) as criteria",
        "get_json_object(metadata, '$.status') as status", "get_json_object(metadata, '$.tags[0]') as tag",
        "get_json_object(metadata, '$.source_file') as source_file", "cast(get_json_object(metadata, '$.total_tokens') as bigint) as total_tokens",
    )
)
query("golden_metadata_shadows", """select id, 'mine' as own, status, 'f1' as source from traces where parent_trace_id is null""")(
    lambda s: s.traces.where("parent_trace_id is null").withColumn("metadata", F.lit('{"status":"mine","source_file":"f1"}')).select(
        "id", export.golden_metadata(s.traces).alias("m")
    ).selectExpr("id", "get_json_object(m, '$.trace_metadata_status') as own", "get_json_object(m, '$.status') as status", "get_json_object(m, '$.source_file') as source")
)
query("baseline_warnings", "select count(*) as entries, count(*) filter (status <> 'completed') as not_completed from traces where parent_trace_id is null")(
    lambda s: export.baseline_warnings(s.traces)
)
query("canonical_inputs", """select id, input as canonical, case when input <> '{}' then substr(sha256(input), 1, 16) end as key from traces""")(
    lambda s: s.traces.select(
        "id", jsons.canonical(F.when(F.col("input") == "{}", " { } ").otherwise(
            F.concat(F.lit('{"priority":"old", "priority": "'), F.get_json_object("input", "$.priority"), F.lit('" , "customer":'), F.get_json_object("input", "$.customer"), F.lit(".0}"))
        )).alias("canonical"),
    ).select("id", "canonical", jsons.input_key(F.col("canonical")).alias("key"))
)
query("answers", """select id, coalesce(output is not null and trace_key % 4 <> 0, false) as answer from traces""")(
    lambda s: s.traces.select("id", jsons.is_answer(F.expr("case when trace_key % 8 = 0 then '\"\"' when trace_key % 4 = 0 then '{\"a\": [null, \" \"]}' else output end")).alias("answer"))
)
query("coerced_columns", """select o_orderkey, case o_orderkey % 4 when 0 then cast(o_custkey as string) when 1 then o_orderpriority end as text,
 case o_orderkey % 3 when 0 then o_totalprice when 1 then cast(o_custkey as double) end as number,
 case when o_orderkey % 9 >= 1 and o_orderkey % 9 < 5 then cast(o_orderkey % 9 as int) end as ref from orders""", raw=True)(
    lambda s: table(s.spark, s.sf_dir, "orders").select(
        "o_orderkey",
        jsons.or_null_text(F.expr("""case o_orderkey % 4 when 0 then cast(o_custkey as string) when 1 then concat('"', o_orderpriority, '"') when 2 then '{"a":1}' else '[2]' end""")).alias("text"),
        jsons.or_null_number(F.expr("case o_orderkey % 3 when 0 then cast(o_totalprice as string) when 1 then concat(' ', cast(o_custkey as string)) else 'NaN' end")).alias("number"),
        jsons.earlier_ref(F.expr("cast(o_orderkey % 9 as string)"), F.lit(5)).alias("ref"),
    )
)
query("duration_texts", """select o_orderkey, case when o_orderkey % 5 = 0 then '-' when o_orderkey % 100000 < 1000 then concat(cast(o_orderkey % 100000 as string), 'ms')
 when o_orderkey % 100000 < 60000 then concat(printf('%.1f', (o_orderkey % 100000) / 1000.0), 's')
 else concat(cast((o_orderkey % 100000) // 60000 as string), 'm ', cast((o_orderkey % 100000) // 1000 % 60 as string), 's') end as took from orders""", raw=True)(
    lambda s: table(s.spark, s.sf_dir, "orders").select(
        "o_orderkey", times.duration_text(F.expr("case when o_orderkey % 5 <> 0 then o_orderkey % 100000 end")).alias("took")
    )
)


def whole_forks(s: Store) -> DataFrame:
    """Every second trace is forked at its third step, and every fifth at one that nobody has."""
    keyed = s.traces.select("id", F.substring("id", 5, 20).cast("bigint").alias("k"))
    points = keyed.where("k % 2 = 0").select("id", F.lit(3).alias("at")).union(keyed.where("k % 5 = 0").select("id", F.lit(99).alias("at")))
    tables = {n: s.records(n) for n in ("decisions", "snapshots")} | {"traces": s.traces.withColumn("metadata", F.lit('{"k":1,"forked_from":"x"}')), "steps": s.steps}
    made, faults = graph.forks(tables, points, "2024-01-01T00:00:00Z", input='{"new":1}', context='{"mine":1}')
    count = lambda name, how=F.count("*"): made[name].groupBy(F.col("trace_id").alias("id")).agg(how.alias(name))
    mine = made["snapshots"].where("context_window = '{\"mine\":1}'").groupBy(F.col("trace_id").alias("id")).agg(F.max("step_number").alias("mine"))
    out = made["traces"].join(count("steps"), "id", "left").join(count("decisions"), "id", "left").join(count("snapshots"), "id", "left").join(mine, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    rows = out.select(F.col("parent_trace_id").alias("original"), "status", "input", "metadata", "session_id", zero("steps"), zero("decisions"), zero("snapshots"), "mine")
    none = F.lit(None).cast("string")
    bad = faults.select(F.col("id").alias("original"), F.col("message").alias("status"), *(none.alias(c) for c in ("input", "metadata", "session_id")), *(F.lit(0).cast("bigint").alias(c) for c in ("steps", "decisions", "snapshots")), F.lit(None).cast("int").alias("mine"))
    return rows.union(bad)


query("fork_whole", """, h as (select distinct trace_id as hid from steps), p as (select id, 3 as pt, session_id from traces where cast(substr(id, 5) as bigint) % 2 = 0 union all select id, 99, null from traces where cast(substr(id, 5) as bigint) % 5 = 0),
 g as (select p.*, s.trace_id is not null as fine from p left join steps s on s.trace_id = p.id and s.step_number = p.pt)
 select id as original, case when fine then 'running' when id in (select hid from h) then 'no such step to fork at' else 'no such trace, or one without steps' end as status, case when fine then '{"new":1}' end as input,
 case when fine then '{"k":1,"forked_from":"' || id || '","forked_at_step":3}' end as metadata, case when fine then session_id end as session_id,
 case when fine then (select count(*) from steps s where s.trace_id = g.id and s.step_number <= g.pt) else 0 end as steps, case when fine then (select count(*) from decisions d where d.trace_id = g.id and d.step_number <= g.pt) else 0 end as decisions,
 case when fine then (select count(*) from snapshots d where d.trace_id = g.id and d.step_number < g.pt) + 1 else 0 end as snapshots, cast(case when fine then 3 end as int) as mine from g""")(whole_forks)
