"""The star-schema tables read as a trace store: orders are traces, line items their steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import instant_ms

TRACE = {
    "id": "concat('trc_', cast(o_orderkey as string))",
    "agent_name": "concat('agent-', lower(c_mktsegment))",
    "status": "case when o_orderkey % 20 = 7 then 'running' when o_orderstatus = 'O' then 'completed'"
    " when o_orderstatus = 'F' then 'failed' else 'timeout' end",
    "started_at": "concat(substr(cast(o_orderdate as string), 1, 10), case when o_orderkey % 4 = 3 then ' ' else 'T' end,"
    " lpad(cast(o_orderkey % 24 as string), 2, '0'), ':00:00',"
    " case o_orderkey % 4 when 0 then 'Z' when 1 then '+02:00' when 2 then '+0200' else '' end)",
    "total_duration_ms": "case when o_orderkey % 2 = 1 then null else cast((o_orderkey % 5000) * 1000 as bigint) end",
    "total_tokens": "case when o_orderkey % 3 = 0 then null else cast(floor(o_totalprice) as bigint) end",
    "total_cost_usd": "case when o_orderkey % 5 = 0 then null else o_totalprice / 100000 end",
    "error": "case when o_orderstatus = 'F' and o_orderkey % 20 <> 7 and o_orderkey % 2 = 0 then 'run failed' end",
    "tag": "lower(o_orderpriority)",
    "parent_trace_id": "case when o_orderkey % 17 = 5 then concat('trc_', cast(o_orderkey - 1 as string)) end",
    "session_id": "concat('sess_', cast(o_custkey as string))",
    "input": "case when o_orderkey % 11 = 0 then '{}' else concat('{\"customer\":', cast(o_custkey as string),"
    " ',\"priority\":\"', o_orderpriority, '\"}') end",
    "output": "case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then '\"I think maybe it ships\"'"
    " when o_orderkey % 13 = 0 then '\"write to a.b@example.com\"' else '\"shipped\"' end",
    "metadata": "case when o_orderkey % 6 = 0 then '{}' else concat('{\"source_file\":\"f', cast(o_custkey % 5 as string), '\",\"attempt\":',"
    " cast(o_orderkey % 3 as string), '}') end",
    "trace_key": "o_orderkey",
}
ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"
STEP = {
    "trace_id": "concat('trc_', cast(l_orderkey as string))",
    "step_number": f"cast(row_number() over (partition by l_orderkey order by {ORDER}) as int)",
    "step_type": "case l_linenumber when 1 then 'thought' when 2 then 'tool_call' when 3 then 'llm_call' when 4 then 'retrieval'"
    " when 5 then 'output' when 6 then 'decision' else 'guard_check' end",
    "name": "replace(p_name, ' ', '_')",
    "input": "concat('{\"part\":', cast(l_partkey as string), ',\"quantity\":', cast(cast(floor(l_quantity) as bigint) as string), '}')",
    "output": "case when l_tax > 0.07 then null else concat('{\"answer\":\"', p_name, ' ', lower(p_type), '\"}') end",
    "tokens_used": "case when l_linenumber % 5 = 0 then null else cast(floor(l_quantity) as bigint) end",
    "model": "case when l_linenumber = 3 then p_brand end",
    "error": "case when l_returnflag = 'R' and l_discount > 0.085 then 'tool failed' end",
    "partkey": "l_partkey",
    "suppkey": "l_suppkey",
    "trace_key": "l_orderkey",
}
REFS = (
    "case when suppkey % 3 = 0 and step_number > 1 then step_number - 1 end as parent_step_number",
    "case when partkey % 4 = 0 and step_number > 2 then step_number - 2 end as caused_by_step_number",
)

#: Records beside the steps and traces, over the columns of these views: name -> (source, condition, columns).
RECORDS = {
    "decisions": ("steps", "step_type = 'decision' or partkey % 13 = 0", {
        "trace_id": "trace_id", "step_number": "step_number",
        "options": "concat('[{\"option\":\"ship\",\"score\":0.', cast(suppkey % 10 as string), '},{\"option\":\"hold\"}]')",
        "chosen": "case when suppkey % 2 = 0 then 'ship' else 'hold' end",
        "rationale": "case when partkey % 3 = 0 then null else concat('rule ', cast(partkey % 7 as string)) end",
        "confidence": "cast(suppkey % 11 as double) / 10",
        "decided_by": "case partkey % 3 when 0 then 'agent' when 1 then 'user' else 'policy' end",
    }),
    "snapshots": ("steps", "suppkey % 5 = 0", {
        "trace_id": "trace_id", "step_number": "step_number", "context_window": "concat('{\"part\":', cast(partkey as string), '}')",
        "environment": "'{}'", "tool_state": "'{}'", "token_count": "cast(partkey % 100 as bigint)",
    }),
    "evals": ("traces", "trace_key % 4 <> 1", {
        "trace_id": "id", "evaluator_type": "'rubric'", "evaluator_name": "case when trace_key % 2 = 0 then 'safety-check' else 'grounded' end",
        "score": "cast(trace_key % 101 as double) / 100", "passed": "trace_key % 101 >= 70",
        "details": "case when trace_key % 9 = 0 then '{\"skipped\":true}' when trace_key % 9 = 1 then '{\"skipped\":false}' else '{}' end",
        "evaluated_ms": "started_ms + (trace_key % 3) * 1000", "seq": "trace_key",
    }),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Store:
    """traces and steps over the tables of a data folder."""

    spark: SparkSession
    sf_dir: str

    @property
    def _orders(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "orders").join(table(self.spark, self.sf_dir, "customer"), F.expr("o_custkey = c_custkey"))

    @cached_property
    def traces(self) -> DataFrame:
        ship = table(self.spark, self.sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
        rows = self._orders.join(ship, F.expr("o_orderkey = l_orderkey"), "left")
        rows = rows.selectExpr(
            *(f"{e} as {n}" for n, e in TRACE.items()),
            "case when o_orderkey % 20 <> 7 then unix_date(cast(ship as date)) * bigint(86400000) + 43200000 end as ended_ms",
        )
        return rows.withColumn("started_ms", instant_ms(F.col("started_at")))

    @cached_property
    def heads(self) -> DataFrame:
        """traces but for their times in ms: their ends alone are found in the line items, a join that Spark keeps where nothing reads them."""
        return self._orders.selectExpr(*(f"{e} as {n}" for n, e in TRACE.items()))

    @cached_property
    def steps(self) -> DataFrame:
        rows = table(self.spark, self.sf_dir, "lineitem").join(table(self.spark, self.sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        # numbered first: the shuffle by trace carries the columns of the tables, and of the texts that are made of them only the id, by which it leaves
        # the steps dealt for all that groups, sorts or joins them by trace
        number = STEP["step_number"].replace("partition by l_orderkey", "partition by __trace")
        rows = rows.withColumn("__trace", F.expr(STEP["trace_id"])).withColumn("__number", F.expr(number))
        # the key is read back from the id, so that conditions on it are met before the shuffle
        made = {"trace_id": "__trace", "step_number": "__number", "trace_key": "cast(substr(__trace, 5) as bigint)"}
        rows = rows.selectExpr(*(f"{made.get(n, e)} as {n}" for n, e in STEP.items()))
        return rows.selectExpr("*", *REFS)

    def records(self, name: str) -> DataFrame:
        """decisions, snapshots or evals."""
        source, where, columns = RECORDS[name]
        return getattr(self, source).where(where).selectExpr(*(f"{e} as {n}" for n, e in columns.items()))


_HOURS = "(o_orderkey % 24 - case when o_orderkey % 4 in (1, 2) then 2 else 0 end) * 3600000"

#: The same views for an oracle in SQL; what follows is one more "name as (...)" list or the query itself.
ORACLE = f"""with recursive ship as (select l_orderkey as k, min(l_shipdate) as ship from lineitem group by 1),
traces as (select {", ".join(f"{e} as {n}" for n, e in TRACE.items())},
 case when o_orderkey % 20 <> 7 then epoch_ms(cast(cast(ship as date) as timestamp)) + 43200000 end as ended_ms,
 epoch_ms(cast(cast(o_orderdate as date) as timestamp)) + {_HOURS} as started_ms
 from orders join customer on o_custkey = c_custkey left join ship on o_orderkey = k),
plain as (select {", ".join(f"{e} as {n}" for n, e in STEP.items())} from lineitem join part on l_partkey = p_partkey),
steps as (select *, {", ".join(REFS)} from plain),
eff as (select t.*, coalesce(n, 0) as step_count, coalesce(total_tokens, cast(s as bigint)) as effective_tokens,
 coalesce(total_duration_ms, case when ended_ms >= started_ms then ended_ms - started_ms end) as duration_ms
 from traces t left join (select trace_id, count(*) as n, sum(tokens_used) as s from steps group by 1) on trace_id = id),
{", ".join(f"{name} as (select {', '.join(f'{e} as {n}' for n, e in cols.items())} from {source} where {where})" for name, (source, where, cols) in RECORDS.items())}
"""
