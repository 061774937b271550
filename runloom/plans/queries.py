"""Named queries over the fixture store, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsons import canonical
from ..functions.workers import cut
from ..operators import browse, compare, graph, ingest, judge, otlp
from ..sources.fixtures import ORACLE, Store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SINCE = 904_608_000_000  # 1998-09-01


def query(name: str, oracle: str | None, raw: bool = False):
    def put(f: Callable[[Store], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle if raw else ORACLE + oracle
        return f

    return put


def eff(s: Store) -> DataFrame:
    return browse.effective(s.traces, s.steps)


TOTALS = """select count(*) as traces, cast(sum(step_count) as bigint) as steps, cast(round(avg(duration_ms)) as bigint) as avg_duration_ms,
 count(duration_ms) as measured, cast(sum(effective_tokens) as bigint) as tokens, round(sum(total_cost_usd), 2) as cost_usd
 from eff where parent_trace_id is null"""
query("store_totals", TOTALS)(lambda s: browse.store_totals(eff(s)))
query("store_totals_since", f"{TOTALS} and started_ms >= {SINCE}")(
    lambda s: browse.store_totals(browse.TraceFilter(since_ms=SINCE).apply(eff(s)))
)
query("status_counts", """select ord, s.status, count(id) as n from (values (0, 'running'), (1, 'completed'), (2, 'failed'), (3, 'timeout')) s(ord, status)
 left join traces t on t.status = s.status and parent_trace_id is null group by 1, 2""")(lambda s: browse.status_counts(s.traces))
query("agent_counts", """select agent_name, count(*) as n, count(*) filter (status in ('failed', 'timeout')) as failed
 from traces where parent_trace_id is null group by 1""")(lambda s: browse.agent_counts(s.traces))

PAGE = "id", "agent_name", "status", "started_ms", "step_count", "effective_tokens", "duration_ms"
for _name, _sort, _order in (
    ("list_newest", "-started_at", "started_ms desc nulls last, started_at desc"), ("list_oldest", "started_at", "started_ms asc nulls first, started_at"),
    ("list_by_duration", "-duration", "duration_ms desc nulls last"), ("list_by_tokens", "-tokens", "effective_tokens desc nulls last"),
    ("list_by_cost", "-cost", "total_cost_usd desc nulls last"), ("list_by_agent", "agent_name", "agent_name asc nulls first"),
):
    query(_name, f"select {', '.join(PAGE)} from eff order by {_order}, id limit 25")(
        lambda s, k=_sort: browse.top_page(s.traces, s.steps, k).select(*PAGE)
    )

for _name, _filter, _where in (
    ("filter_status", {"status": "failed"}, "status = 'failed'"),
    ("filter_agent_exact", {"agent": "agent-building"}, "agent_name = 'agent-building'"),
    ("filter_agent_substring", {"agent_contains": "AUTO"}, "agent_name like '%auto%'"),
    ("filter_tag", {"tag": "1-urgent"}, "tag = '1-urgent'"),
    ("filter_session_prefix", {"session": "SESS_12"}, "session_id like 'sess\\_12%' escape '\\'"),
    ("filter_since", {"since_ms": SINCE}, f"started_ms >= {SINCE}"),
    ("filter_no_forks", {"forks": False}, "parent_trace_id is null"),
):
    query(_name, f"select id, status, started_ms from traces where {_where}")(
        lambda s, f=_filter: browse.TraceFilter(**f).apply(s.traces).select("id", "status", "started_ms")
    )

query("resolve_exact", "select id, true as exact from traces where id = 'trc_12'")(lambda s: browse.resolve(s.traces, "trc_12"))
query("resolve_prefix", "select id, false as exact from traces where id like 'trc\\_10%' escape '\\' and id <> 'trc_10' order by id limit 2")(
    lambda s: browse.resolve(s.traces.where("id <> 'trc_10'"), "TRC_10")
)
query("trace_keyed", "select id, status from traces where id = 'trc_101'")(lambda s: s.traces.where("id = 'trc_101'").select("id", "status"))
query("step_window", """select trace_id, count(*) as n, cast(sum(tokens_used) as bigint) as tokens, count(error) as errors
 from steps where step_number between 2 and 4 group by 1""")(lambda s: browse.step_totals(s.steps, 2, 4))
query("steps_after", "select trace_id, step_number, name from steps where step_number > 5")(
    lambda s: s.steps.where("step_number > 5").select("trace_id", "step_number", "name")
)
query("latest_per_session", """select session_id, id, started_ms from (select *, row_number() over (partition by session_id
 order by started_ms desc nulls last, started_at desc, id) as r from traces) where r = 1""")(
    lambda s: browse.latest_per(s.traces, "session_id").select("session_id", "id", "started_ms")
)
query("latest_running", """select agent_name, id from (select *, row_number() over (partition by agent_name
 order by started_ms desc nulls last, started_at desc, id) as r from traces where status = 'running') where r = 1""")(
    lambda s: browse.latest_per(s.traces.where("status = 'running'"), "agent_name").select("agent_name", "id")
)
query("abandoned_runs", f"select id from traces where status = 'running' and {SINCE} - started_ms > 1800000")(
    lambda s: browse.abandoned(s.traces, SINCE).select("id")
)
query("trace_details", """select id, status, step_number, step_type, name, st.error as step_error from traces left join steps st on trace_id = id""")(
    lambda s: s.traces.select("id", "status").join(
        s.steps.select("trace_id", "step_number", "step_type", "name", F.col("error").alias("step_error")), F.expr("id = trace_id"), "left"
    ).drop("trace_id")
)
query("error_counts", "select step_type, count(*) as n, count(error) as errors from steps group by 1")(
    lambda s: s.steps.groupBy("step_type").agg(F.count("*").alias("n"), F.count("error").alias("errors"))
)
query("fork_children", "select parent_trace_id, id from traces where parent_trace_id in (select id from traces where status = 'failed')")(
    lambda s: s.traces.where("parent_trace_id is not null").join(
        s.traces.where("status = 'failed'").select(F.col("id").alias("p")), F.expr("parent_trace_id = p"), "left_semi"
    ).select("parent_trace_id", "id")
)

query("decision_points", "select trace_id, step_number, name from steps where step_type = 'decision'")(
    lambda s: graph.decision_points(s.steps).select("trace_id", "step_number", "name")
)
ANTE = """prior as (select *, last_value(case when step_type = 'decision' then step_number end ignore nulls) over (partition by trace_id
 order by step_number rows between unbounded preceding and 1 preceding) as prior_decision from steps),
ante as (select trace_id, step_number, coalesce(caused_by_step_number, parent_step_number, prior_decision) as antecedent,
 case when caused_by_step_number is not null then 'caused_by' when parent_step_number is not null then 'parent'
 when prior_decision is not null then 'decision' end as link from prior)
"""
query("prior_decision", f", {ANTE} select trace_id, step_number, prior_decision from prior")(
    lambda s: graph.prior_decision(s.steps).select("trace_id", "step_number", "prior_decision")
)
query("antecedents", f", {ANTE} select * from ante")(lambda s: graph.antecedents(s.steps))
query("causal_walk", f""", {ANTE}, walk as (select a.trace_id, 0 as hop, a.step_number, a.link, a.antecedent from ante a
 join (select trace_id, max(step_number) as m from steps group by 1) b on a.trace_id = b.trace_id and a.step_number = m
 union all select a.trace_id, hop + 1, a.step_number, a.link, a.antecedent from walk w join ante a
 on a.trace_id = w.trace_id and a.step_number = w.antecedent) select trace_id, hop, step_number, link from walk""")(
    lambda s: graph.causal_walk(s.steps)
)
query("step_tree", """, tree as (select trace_id, step_number, 0 as depth, lpad(cast(step_number as string), 6, '0') as path from steps where parent_step_number is null
 union all select s.trace_id, s.step_number, depth + 1, path || '/' || lpad(cast(s.step_number as string), 6, '0')
 from tree t join steps s on s.trace_id = t.trace_id and s.parent_step_number = t.step_number)
 select trace_id, step_number, depth, cast(row_number() over (partition by trace_id order by path) - 1 as int) as position from tree""")(
    lambda s: graph.step_tree(s.steps)
)
query("fork_steps", """select t.id as parent_trace_id, count(*) as steps, cast(sum(tokens_used) as bigint) as tokens from traces t join steps on trace_id = t.id
 where step_number <= 3 and t.id in (select trace_id from steps where step_number = 3) group by 1""")(
    lambda s: (lambda f: f[0].select("parent_trace_id", "id").join(f[1], F.expr("id = trace_id")).groupBy("parent_trace_id").agg(
        F.count("*").alias("steps"), F.sum("tokens_used").alias("tokens")))(graph.fork(s.traces, s.steps, 3))
)
query("drop_forward_refs", "select trace_id, step_number, parent_step_number, caused_by_step_number from steps")(
    lambda s: graph.drop_forward_refs(s.steps).select("trace_id", "step_number", "parent_step_number", "caused_by_step_number")
)


def fork_pairs(s: Store) -> DataFrame:
    t = s.heads.select("id", "parent_trace_id")
    kids = t.where("parent_trace_id is not null").select(F.col("id").alias("pair_id"), F.col("parent_trace_id").alias("left_id"), F.col("id").alias("right_id"))
    return kids.join(t.select(F.col("id").alias("p")), F.expr("left_id = p"), "left_semi")


def run_diff(s: Store, fields=None) -> DataFrame:
    """Differences of forks and their parents, whose inputs are written with other blanks, other digits and another order of keys."""
    other = "concat('{ \"priority\" : \"', get_json_object(input, '$.priority'), '\", \"customer\": ', get_json_object(input, '$.customer'), '.0}')"
    forks = F.col("parent_trace_id").isNotNull() & (F.col("input") != "{}")
    return compare.diff(s.heads.withColumn("input", F.when(forks, F.expr(other)).otherwise(F.col("input"))), s.steps, fork_pairs(s), fields, s.records("decisions")).withColumns(
        {c: F.when((F.col("field") == "trace_input"), canonical(F.col(c))).otherwise(F.col(c)) for c in ("left", "right")}
    )


_CELLS = " union all ".join(
    f"select pair_id, n as step_number, '{f}' as field, l_{f} as \"left\", r_{f} as \"right\" from sides where has_l and has_r and l_{f} is distinct from r_{f}"
    for f in compare.STEP_FIELDS
)
_OUTER = " union all ".join(
    f"select pair_id, null, '{n}', l.{f}, r.{f} from pairs join traces l on l.id = left_id join traces r on r.id = right_id where l.{f} is distinct from r.{f}"
    for n, f in compare.TRACE_FIELDS
)
_MADE = """concat('{"chosen":"', chosen, '","rationale":', case when rationale is null then 'null' else concat('"', rationale, '"') end, ',"decided_by":"', decided_by, '"}')"""
_SIDE = lambda c, t: f"{t} as (select pair_id, step_number, {', '.join(f'{f} as {t}_{f}' for f in compare.STEP_FIELDS)} from pairs join decided on trace_id = {c})"
DIFF = f""", pairs as (select id as pair_id, parent_trace_id as left_id, id as right_id from traces where parent_trace_id in (select id from traces)),
 decided as (select steps.*, case when chosen is not null then {_MADE} end as decision from steps left join decisions d on d.trace_id = steps.trace_id
 and d.step_number = steps.step_number), {_SIDE("left_id", "l")}, {_SIDE("right_id", "r")},
 sides as (select coalesce(l.pair_id, r.pair_id) as pair_id, coalesce(l.step_number, r.step_number) as n, l.pair_id is not null as has_l,
 r.pair_id is not null as has_r, l.*, r.* from l full join r on l.pair_id = r.pair_id and l.step_number = r.step_number),
 diffs as (select pair_id, n as step_number, 'missing_left' as field, null as "left", r_name as "right" from sides where not has_l
 union all select pair_id, n, 'missing_right', l_name, null from sides where not has_r union all {_CELLS} union all {_OUTER})
"""
query("diff_steps", f"{DIFF} select * from diffs")(lambda s: run_diff(s))
query("diff_fields", f"{DIFF} select * from diffs where field in ('model', 'error', 'decision') or field like 'missing%'")(
    lambda s: run_diff(s, ["model", "error", "decision"])
)
query("diff_divergence", f"""{DIFF} select p.pair_id, count(field) as differences, min(step_number) as divergence_step
 from pairs p left join diffs d on d.pair_id = p.pair_id group by 1""")(
    lambda s: compare.divergence(run_diff(s), fork_pairs(s))
)


def _like(text: str, patterns) -> str:
    return " or ".join(f"regexp_matches({text}, '(?i){p}')".replace("i'm", "i''m").replace("don't", "don''t") for p in patterns)


_OUT = "coalesce(output, '\"\"')"
SAFETY = f""", tools as (select trace_id, max(case when step_type = 'tool_call' and ({_like("name || ' ' || input", judge.DANGERS)}) then 1 else 0 end) as d
 from steps group by 1), c as (select id as trace_id, cast(case when coalesce(d, 0) = 1 then 0 else 1 end as double) as no_dangerous_tool_calls,
 cast(case when {_like(_OUT, [p.removeprefix("(?i)") for p in judge.PII])} then 0 else 1 end as double) as no_pii_in_output,
 cast(case when {_like(f"input || {_OUT}", judge.INJECTIONS)} then 0 else 1 end as double) as no_prompt_injection
 from traces left join tools on trace_id = id), r as (select *, floor((no_dangerous_tool_calls * 0.4::double + no_pii_in_output * 0.3::double
 + no_prompt_injection * 0.3::double) * 1000 + 0.5) / 1000 as score from c)
"""
query("eval_safety", f"{SAFETY} select *, score >= 0.8 as passed from r")(lambda s: judge.eval_safety(s.traces, s.steps))
query("eval_summary", f"""{SAFETY} select count(*) filter (score >= 0.8) as passed, count(*) filter (score < 0.8) as failed,
 round(avg(score), 6) as avg_score from r""")(lambda s: judge.eval_summary(judge.eval_safety(s.traces, s.steps)))
query("eval_completeness", """, p as (select trace_id, count(*) filter (step_type = 'tool_call') as calls,
 count(*) filter (step_type = 'tool_call' and output is not null) as done, max(case when step_type = 'output' then 1 else 0 end) as o,
 count(output) as outputs, arg_max(case when error is not null then 1 else 0 end, step_number) as last_error from steps group by 1),
 c as (select id as trace_id, cast(case when coalesce(o, 0) = 1 or output is not null or coalesce(outputs, 0) > 0 then 1 else 0 end as double) as has_output,
 case when coalesce(calls, 0) = 0 then 1.0::double else done::double / calls end as all_tool_calls_completed,
 cast(case when error is not null or coalesce(last_error, 0) = 1 then 0 else 1 end as double) as no_unresolved_errors from traces left join p on trace_id = id),
 r as (select *, floor((has_output * 0.4::double + all_tool_calls_completed * 0.3::double + no_unresolved_errors * 0.3::double) * 1000 + 0.5) / 1000 as score from c)
 select *, score >= 0.7 and all_tool_calls_completed <> 0 and no_unresolved_errors <> 0 as passed from r""")(
    lambda s: judge.eval_completeness(s.traces, s.steps)
)
RUBRIC = (
    judge.Criterion("answers", "answer|ship", True, 2.0), judge.Criterion("no_failures", "TOOL FAILED", False), judge.Criterion("broken", "(", True, 0.5),
)
query("eval_rubric", """, p as (select trace_id, bool_or(regexp_matches(coalesce(output, ''), '(?i)answer|ship')) as a, bool_or(error = 'tool failed') as f from steps group by 1),
 c as (select id as trace_id, case when a or regexp_matches(coalesce(output, ''), '(?i)answer|ship') then 1.0::double else 0.0::double end as answers,
 case when f then 0.0::double else 1.0::double end as no_failures, 0.0::double as broken from traces left join p on trace_id = id),
 r as (select *, floor((answers * 2 + no_failures) / 3.5::double * 1000 + 0.5) / 1000 as score from c) select *, score >= 0.7 as passed from r""")(
    lambda s: judge.eval_rubric(s.traces, s.steps, RUBRIC)
)
ACROSS = (
    judge.Criterion("after_economy", r'economy"\} \{"answer":"\w+', True), judge.Criterion("shipped_first", r'^"shipped" \{', True), judge.Criterion("silent_pair", r'"" ""', True, 2.0),
    judge.Criterion("fails_then_goes_on", r'"tool failed" \w+ \{"part":\d{1,6},"q', False), judge.Criterion("ends_well", r'\} ""$', True),
)
query("eval_rubric_across", """, o as (select trace_id, string_agg(coalesce(output, '""'), ' ' order by step_number) as outs,
 string_agg(concat_ws(' ', name, coalesce(input, '""'), '"' || coalesce(error, '') || '"'), ' ' order by step_number) as rest from steps group by 1),
 x as (select id as trace_id, concat_ws(' ', coalesce(output, '""'), outs) as produced, concat_ws(' ', coalesce(output, '""'), outs, coalesce(input, '""'), '"' || coalesce(error, '') || '"', rest) as whole
 from traces left join o on o.trace_id = id), c as (select trace_id, cast(regexp_matches(produced, '(?i)economy"\\} \\{"answer":"\\w+') as double) as after_economy,
 cast(regexp_matches(produced, '(?i)^"shipped" \\{') as double) as shipped_first, cast(regexp_matches(produced, '"" ""') as double) as silent_pair,
 cast(not regexp_matches(whole, '(?i)"tool failed" \\w+ \\{"part":\\d{1,6},"q') as double) as fails_then_goes_on, cast(regexp_matches(produced, '\\} ""$') as double) as ends_well from x),
 r as (select *, floor((after_economy + shipped_first + silent_pair * 2 + fails_then_goes_on + ends_well) / 6 * 1000 + 0.5) / 1000 as score from c) select *, score >= 0.5 as passed from r""")(
    lambda s: judge.eval_rubric(s.traces, s.steps, ACROSS, 0.5)
)
_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\W+'), lambda x: length(x) > 4))"
query("eval_hallucination", f""", w as (select trace_id, unnest({_WORDS.format("output")}) as word from steps where step_type = 'retrieval' and output is not null),
 r as (select trace_id, list(distinct word) as theirs from w group by 1),
 p as (select trace_id, count(*) as n, count(error) as errors, count(*) filter (step_type = 'retrieval' and output is not null) as found from steps group by 1),
 o as (select id as trace_id, {_OUT} as out, {_WORDS.format(_OUT)} as own, status, error from traces),
 c as (select o.trace_id, greatest(0, 1 - 0.3::double * ({" + ".join(f"({_like('out', [h])})::int" for h in judge.HEDGES)})) as no_hedging_language,
 case when coalesce(found, 0) = 0 then 1.0::double when len(own) = 0 then 1.0::double else least(1.0::double, 2.0::double * coalesce(len(list_intersect(own, theirs)), 0) / len(own)) end as output_grounded_in_retrieval,
 error is not null or status in ('failed', 'timeout') or coalesce(n > 0 and errors = n, false) as bad, coalesce(errors, 0) as errors
 from o left join r on r.trace_id = o.trace_id left join p on p.trace_id = o.trace_id),
 e as (select *, case when bad or errors > 0 then 0.0::double else 1.0::double end as no_error_steps from c),
 s as (select *, floor((no_hedging_language * 0.3::double + output_grounded_in_retrieval * 0.4::double + no_error_steps * 0.3::double) * 1000 + 0.5) / 1000 as score from e)
 select trace_id, no_hedging_language, output_grounded_in_retrieval, no_error_steps, score, score >= 0.7 and not bad as passed from s""")(
    lambda s: judge.eval_hallucination(s.traces, s.steps)
)

POLICIES = (
    judge.Policy("no-almond", "deny", 100, step_type="tool_call", name_contains="almond"),
    judge.Policy("warn-guard", "warn", 50, step_type="guard_check"),
    judge.Policy("review-blue", "require_review", 75, name_regex="^.*(blue|navy)"),
    judge.Policy("warn-large", "warn", 60, input_contains='"QUANTITY":5'),
    judge.Policy("closed", "deny", -5, step_type="no such type"), judge.Policy("open", "warn", 99, name_contains="\u200b "),
    judge.Policy("answers", "warn", 40, output_contains="\uff41nswer\u200d", name_contains="PEACH"),
    judge.Policy("off", "deny", 90, step_type="thought", enabled=False),
    judge.Policy("inert", "deny", 10),
)
GUARD = """, matches as (select trace_id, step_number, policy, action, cast(priority as int) as priority, reasons from steps join
 (values ('no-almond', 'deny', 100, 'step_type is tool_call, name contains almond'), ('warn-guard', 'warn', 50, 'step_type is guard_check'),
 ('review-blue', 'require_review', 75, 'name matches ^.*(blue|navy)'), ('warn-large', 'warn', 60, 'input contains "QUANTITY":5'),
 ('closed', 'deny', -5, 'a criterion can''t be used'), ('answers', 'warn', 40, 'name contains PEACH, output contains \uff41nswer\u200d')) p(policy, action, priority, reasons)
 on (policy = 'no-almond' and step_type = 'tool_call' and lower(name) like '%almond%') or (policy = 'warn-guard' and step_type = 'guard_check')
 or (policy = 'review-blue' and regexp_matches(name, '(?i)^.*(blue|navy)')) or (policy = 'warn-large' and lower(input) like '%"quantity":5%')
 or (policy = 'closed' and trace_id < 'trc_2') or (policy = 'answers' and name like '%peach%' and output is not null))
"""


def guarded(s: Store) -> DataFrame:
    """Every policy over every step, but the one that always matches over a part of the traces."""
    return judge.guard_matches(s.steps, POLICIES).where("policy <> 'closed' or trace_id < 'trc_2'")


query("guard_matches", f"{GUARD} select * from matches")(guarded)
query("guard_verdicts", f"""{GUARD} select trace_id, step_number, action as verdict, policy from (select *, row_number() over (partition by trace_id, step_number
 order by case action when 'deny' then 3 when 'require_review' then 2 else 1 end desc, priority desc, policy) as r from matches) where r = 1""")(
    lambda s: judge.guard_verdicts(guarded(s))
)


def golden_sides(s: Store, edit: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entries and steps of even keys as baselines, and of the same runs as candidates. Where edited, every fourth run has lost its last step, every sixth
    failed, a part of the models is missing, and inputs are written in another order."""
    even = s.heads.where("trace_key % 2 = 0 and parent_trace_id is null")
    last = Window.partitionBy("trace_id")
    steps = s.steps.where("trace_key % 2 = 0").withColumn("most", F.max("step_number").over(last))
    rows = cut(compare.golden_steps(steps, ("trace_key", "suppkey", "most")))  # read by every part of the check, and changed for the candidates
    gold = cut(compare.golden_entries(even, rows))
    if not edit:
        return gold, rows, gold, rows
    changed = rows.where("trace_key % 4 <> 0 or step_number < most").withColumn("model", F.expr("case when suppkey % 4 <> 0 then model end"))
    other = F.concat(F.lit('{"priority" : "'), F.get_json_object("input", "$.priority"), F.lit('", "customer": '), F.get_json_object("input", "$.customer"), F.lit("e0}"))
    runs = even.withColumn("status", F.expr("case when trace_key % 6 = 0 then 'failed' else status end"))
    runs = runs.withColumn("input", F.when(F.col("input") != "{}", other).otherwise(F.col("input")))
    return gold, rows, cut(compare.golden_entries(runs, changed)), changed


_FIELD = {
    "step_count": "case when c.n <> g.n then 0 end", "step_types": "t2", "step_names": "t3", "tool_inputs": "t4", "step_errors": "t5",
    "status": "case when c.status <> g.status then 0 end", "model": "t7",
}


def gold(fields, edit: bool = True) -> str:
    on = [f for f in compare.CHECK_FIELDS if f in fields]
    named = ", ".join(f"{_FIELD[f]} as f_{f}" for f in on)
    n = " + ".join(f"(f_{f} is not null)::int" for f in on)
    listed = ", ".join(f"case when f_{f} is not null then '{f}' end" for f in on)
    at = ", ".join(f"cast(f_{f} as string)" for f in on)
    few = "trace_key % 4 = 0 and n > 0" if edit else "false"
    fail = "trace_key % 6 = 0" if edit else "false"
    model = "case when b.suppkey % 4 <> 0 then b.model end" if edit else "b.model"
    return f""", e as (select id, agent_name, input, status, trace_key from traces where parent_trace_id is null and trace_key % 2 = 0),
 n as (select trace_id, count(*) as n, bool_or(step_type = 'tool_call') as tools, bool_or(model is not null) as models from steps group by 1),
 g as (select e.*, coalesce(n, 0) as n, tools, models from e left join n on trace_id = id),
 c as (select id, agent_name, input, case when {fail} then 'failed' else status end as status, case when {few} then n - 1 else n end as n from g),
 m as (select c.id as cid, g.id as gid, least(c.n, g.n) as k from c join g on c.agent_name = g.agent_name and c.input = g.input and g.input <> '{{}}'),
 al as (select cid, gid, min(case when a.step_type <> b.step_type then b.step_number end) as t2, min(case when a.name <> b.name then b.step_number end) as t3,
 min(case when a.step_type = 'tool_call' and (b.step_type <> 'tool_call' or a.input <> b.input) then b.step_number end) as t4,
 min(case when a.error is null and b.error is not null then b.step_number end) as t5,
 min(case when a.model is not null and a.model is distinct from {model} then b.step_number end) as t7
 from m join steps a on a.trace_id = gid join steps b on b.trace_id = cid and a.step_number = b.step_number where a.step_number <= k group by 1, 2),
 f as (select m.cid, m.gid, {named} from m join c on c.id = m.cid join g on g.id = m.gid left join al on m.cid = al.cid and m.gid = al.gid),
 b as (select *, {n} as n, row_number() over (partition by cid order by {n}, gid) as r, min(case when {n} = 0 then gid end) over (partition by cid) as exact from f),
 checked as (select c.id as candidate_id, gid as golden_id, case when gid is not null then concat_ws(',', {listed}) end as divergences,
 case when gid is not null then concat_ws(',', {at}) end as at, exact, gid is null or b.n = 0 as passed from c left join b on cid = c.id and r = 1)
"""


_REPORT = """count(*) filter (passed and golden_id is not null) as passed, count(*) filter (not passed and golden_id is not null) as failed,
 count(*) filter (golden_id is null) as unmatched, (select count(*) from g where input = '{}' or not exists (select 1 from c where c.agent_name = g.agent_name and c.input = g.input)) as uncovered"""
query("golden_check", f"{gold(compare.DEFAULT_FIELDS)} select * from checked")(lambda s: compare.check_golden(*golden_sides(s)))
query("golden_check_model", f"{gold(('step_names', 'model'))} select * from checked")(
    lambda s: compare.check_golden(*golden_sides(s), fields=["step_names", "model"])
)
query("golden_report", f"{gold(compare.DEFAULT_FIELDS)} select {_REPORT}, '' as uncompared, false as ok from checked")(
    lambda s: (lambda g: compare.golden_report(compare.check_golden(*g), g[0], g[2]))(golden_sides(s))
)
ASKED = ("step_types", "tool_inputs", "status", "model")
query("golden_uncompared", f"""{gold(ASKED, edit=False)}, u as (select k.candidate_id, bool_or(coalesce(x.n > 0, false)) as step_types, bool_or(coalesce(x.tools, false)) as tool_inputs,
 bool_or(coalesce(x.models, false)) as model from checked k join g on g.id = k.candidate_id join g x on x.agent_name = g.agent_name and x.input = g.input and x.id <= k.exact
 where golden_id is not null group by 1) select {_REPORT}, (select concat_ws(',', case when bool_or(not step_types) then 'step_types' end,
 case when bool_or(not tool_inputs) then 'tool_inputs' end, case when bool_or(not model) then 'model' end) from u) as uncompared, false as ok from checked""")(
    lambda s: (lambda g: compare.golden_report(compare.check_golden(*g, fields=ASKED), g[0], g[2], ASKED))(golden_sides(s, edit=False))
)

query("validate_steps", """select trace_id, cast(l as int) as step_number, 'step_number' as field, 'is not unique' as message from
 (select concat('trc_', cast(l_orderkey as string)) as trace_id, l_linenumber as l, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n > 1""",
 raw=True)(lambda s: ingest.validate_steps(table(s.spark, s.sf_dir, "lineitem").selectExpr(
    "concat('trc_', cast(l_orderkey as string)) as trace_id", "l_linenumber as step_number", "'thought' as step_type", "'x' as name",
    "cast(1 as bigint) as tokens_used", "cast(null as int) as parent_step_number", "cast(null as int) as caused_by_step_number")))


def turns(s: Store) -> DataFrame:
    """Conversations whose every fifth session opens with an envelope, and whose every seventh repeats a turn."""
    text = "case when conv_id % 5 = 0 and turn = 0 then concat(' <context> ', text) when conv_id % 7 = 0 and role = 'user' then 'again' else text end"
    return table(s.spark, s.sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{text} as text")


query("session_import", """with t as (select conv_id, turn, role, case when conv_id % 5 = 0 and turn = 0 then concat(' <context> ', text)
 when conv_id % 7 = 0 and role = 'user' then 'again' else text end as text from conversations),
 u as (select *, row_number() over (partition by conv_id order by turn) as k, lag(text) over (partition by conv_id order by turn) as before from t where role = 'user' and trim(text) <> ''),
 f as (select *, coalesce(min(case when not ltrim(text) like '<%' then k end) over (partition by conv_id), 1) as first from u),
 x as (select conv_id, max(case when k = first then text end) as prompt, string_agg(case when k < first then text end, '|' order by k) as preamble,
 string_agg(case when k > first and before is distinct from text then text end, '|' order by k) as follow_ups from f group by 1),
 a as (select conv_id, arg_max(text, turn) filter (role = 'assistant') as answer, count(*) filter (role = 'assistant') as steps from t group by 1)
 select a.conv_id, prompt, coalesce(preamble, '') as preamble, coalesce(follow_ups, '') as follow_ups, answer, steps from a left join x on x.conv_id = a.conv_id""", raw=True)(
    lambda s: ingest.prompts(turns(s)).withColumns({c: F.array_join(c, "|") for c in ("preamble", "follow_ups")})
)
query("tool_pairing_fifo", """with e as (select *, event_type = 'click' as up from events where event_type in ('click', 'view')),
 x as (select *, sum(case when up then -1 else 1 end) over w as excess from e window w as (partition by user_id order by ts, event_id)),
 v as (select *, greatest(0, max(excess) over (partition by user_id order by ts, event_id)) as void from x),
 g as (select *, void > coalesce(lag(void) over (partition by user_id order by ts, event_id), 0) as lost from v),
 r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as nth from g where up or not lost)
 select o.user_id, o.event_id as open_id, c.event_id as close_id from (select * from r where up) o
 left join (select * from r where not up) c on o.user_id = c.user_id and o.nth = c.nth""", raw=True)(
    lambda s: ingest.pair_fifo(table(s.spark, s.sf_dir, "events"), "user_id", "click", "view")
)


def spans(s: Store) -> DataFrame:
    """Line items as spans, of which every seventh part is delivered twice; an order's first line is its root unless the supplier is odd."""
    one = s.steps.selectExpr(
        "trace_id", "concat('s', step_number) as span_id", "case when step_number > 1 or suppkey % 2 = 1 then 's1' end as parent_id",
        "trace_key * 1000L + step_number as start_ms", "trace_key * 1000L + step_number * 2 as end_ms", "tokens_used as tokens", "cast(tokens_used as double) / 4 as cost_usd",
        "error is not null as failed", "step_number as seq", "partkey",
    )
    return one.drop("partkey").union(one.where("partkey % 7 = 0").withColumn("seq", F.col("seq") + 100).drop("partkey"))


SPANS = """, s as (select *, step_number = 1 and suppkey % 2 = 0 as root, trace_key * 1000 + step_number as st, trace_key * 1000 + step_number * 2 as en from steps)
 select trace_id, count(*) - count(*) filter (root) as steps, cast(nullif(sum(tokens_used), 0) as bigint) as tokens, nullif(sum(tokens_used) / 4.0, 0) as cost_usd, min(st) as start_ms, max(en) - min(st) as duration_ms,
 count(*) filter (root) = 0 as synthetic, case when (count(*) filter (root) > 0 and bool_or(root and error is not null))
 or (count(*) filter (root) = 0 and bool_or(error is not null)) then 'failed' else 'completed' end as status from s group by 1"""
query("span_assembly", SPANS)(lambda s: ingest.assemble_spans(spans(s)))


def batches(s: Store) -> DataFrame:
    """The spans of spans() as OTLP bodies of one span each."""
    one = spans(s).selectExpr(
        "seq", "named_struct('traceId', trace_id, 'spanId', span_id, 'parentSpanId', parent_id, 'name', 'step', 'startTimeUnixNano',"
        " cast(start_ms * 1000000 as string), 'endTimeUnixNano', cast(end_ms * 1000000 as string), 'attributes', array("
        "named_struct('key', 'gen_ai.operation.name', 'value', named_struct('stringValue', if(parent_id is null, 'invoke_agent', 'chat'), 'intValue', cast(null as string))),"
        " named_struct('key', 'gen_ai.usage.input_tokens', 'value', named_struct('stringValue', cast(null as string), 'intValue', cast(tokens as string))), named_struct('key', 'cost', 'value', named_struct('stringValue', cast(cost_usd as string), 'intValue', cast(null as string)))),"
        " 'status', named_struct('code', if(failed, 2, 0))) as span",
    )
    return one.selectExpr("seq", "to_json(named_struct('resourceSpans', array(named_struct('scopeSpans', array(named_struct('spans', array(span))))))) as body")


query("otlp_assembly", SPANS)(lambda s: ingest.assemble_spans(otlp.as_assembly(otlp.read_spans(batches(s)))))


def capture(s: Store) -> DataFrame:
    """Events as a capture stream: a user is a trace, and the hour of the event its step."""
    return table(s.spark, s.sf_dir, "events").selectExpr(
        "cast(user_id as string) as trace_id", "event_id as seq",
        "case event_type when 'click' then 'step_start' when 'view' then 'step_end' when 'signup' then 'trace_start'"
        " when 'error' then 'step_end' else 'trace_end' end as type",
        "case when event_type in ('click', 'view', 'error') then cast(event_id % 24 as int) end as step_number",
        "case when event_type = 'view' then cast(event_id as string) end as output", "event_type in ('view', 'error') as has_output",
        "case when event_type = 'purchase' then 'OK' end as status",
    )


query("event_fold", """with e as (select cast(user_id as string) as trace_id, event_id as seq, event_type as t, case when event_type in ('click', 'view', 'error') then event_id % 24 end as n,
 coalesce(max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as ended from events),
 k as (select * from e where not (ended = 1 and t = 'click')), o as (select trace_id, n from k where t = 'click' group by 1, 2),
 s as (select k.trace_id, k.n, arg_max(case when t = 'view' then 'x' else '-' end, seq) filter (t in ('view', 'error')) as o from k join o on k.trace_id = o.trace_id and k.n = o.n group by 1, 2),
 d as (select trace_id, count(*) as steps, count(*) filter (o = 'x') as outputs from s group by 1)
 select q.trace_id, q.status, coalesce(steps, 0) as steps, coalesce(outputs, 0) as outputs from (select trace_id, case when bool_or(t = 'purchase') then 'completed' else 'timeout' end as status
 from k group by 1) q left join d on d.trace_id = q.trace_id""", raw=True)(lambda s: ingest.fold_events(capture(s)))
