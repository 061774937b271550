"""Browsing a trace store: derived totals, filters, sort orders, pages and roll-ups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses in their order.
STATUSES = ("running", "completed", "failed", "timeout")
SORTS = {"started_at": "started_ms", "duration": "duration_ms", "tokens": "effective_tokens", "cost": "total_cost_usd", "agent_name": "agent_name"}


def effective(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """traces with step_count, effective_tokens and duration_ms; nothing measured stays null."""
    per = steps.groupBy(F.col("trace_id").alias("__t")).agg(F.count("*").alias("__n"), F.sum("tokens_used").alias("__s"))
    rows = traces.join(per, traces.id == F.col("__t"), "left")
    took = F.when(F.col("ended_ms") >= F.col("started_ms"), F.col("ended_ms") - F.col("started_ms"))
    return rows.select(
        *traces.columns, F.coalesce("__n", F.lit(0)).cast("bigint").alias("step_count"),
        F.coalesce("total_tokens", "__s").alias("effective_tokens"), F.coalesce("total_duration_ms", took).alias("duration_ms"),
    )


@dataclass(frozen=True)
class TraceFilter:
    """Narrowing of a page. An empty value is refused: it would not narrow anything."""

    status: str | None = None
    agent: str | None = None
    agent_contains: str | None = None
    tag: str | None = None
    session: str | None = None
    since_ms: int | None = None
    forks: bool = True

    def __post_init__(self) -> None:
        for name in ("status", "agent", "agent_contains", "tag", "session"):
            if getattr(self, name) == "":
                raise ValueError(f"{name} is empty")
        if self.status is not None and self.status not in STATUSES:
            raise ValueError(f"unknown status {self.status!r}")

    def condition(self, traces: DataFrame) -> Column:
        c = F.lit(True)
        if self.status:
            c &= F.col("status") == self.status
        if self.agent:
            c &= F.col("agent_name") == self.agent
        elif self.agent_contains:
            c &= F.lower("agent_name").contains(self.agent_contains.lower())
        if self.tag:
            c &= (F.col("tag") == self.tag) if "tag" in traces.columns else F.array_contains("tags", self.tag)
        if self.session:
            c &= (F.col("session_id") == self.session) | F.lower("session_id").startswith(self.session.lower())
        if self.since_ms is not None:  # a start that can't be read is compared as text
            text = datetime.fromtimestamp(self.since_ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
            c &= F.coalesce(F.col("started_ms") >= self.since_ms, F.col("started_at") >= text)
        if not self.forks:
            c &= F.col("parent_trace_id").isNull()
        return c

    def apply(self, traces: DataFrame) -> DataFrame:
        return traces.where(self.condition(traces))


def page(rows: DataFrame, sort: str = "-started_at", limit: int = 25, offset: int = 0) -> DataFrame:
    """One page; ties by id; a limit of -1 gives all rows."""
    name = sort.removeprefix("-")
    if name not in SORTS:
        raise ValueError(f"unknown sort key {name!r}")
    key = F.col(SORTS[name])
    down = sort.startswith("-")
    order = [key.desc_nulls_last() if down else key.asc_nulls_first()]
    if name == "started_at":  # times that can't be told apart, or read, go by their text
        order.append(F.col("started_at").desc() if down else F.col("started_at").asc())
    rows = rows.orderBy(*order, "id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit < 0 else rows.limit(limit)


def resolve(traces: DataFrame, ref: str) -> DataFrame:
    """The exact id, or else at most two ids with the prefix (case folded); two mean that the reference is ambiguous. A blank one finds nothing."""
    if not ref.strip():
        return traces.select("id", F.lit(False).alias("exact")).limit(0)
    near = traces.where(F.lower("id").startswith(ref.lower())).select("id", (F.col("id") == ref).alias("exact"))
    near = near.orderBy(F.col("exact").desc(), "id").limit(2)
    return near.withColumn("__any", F.max("exact").over(Window.partitionBy(F.lit(1)))).where("exact or not __any").drop("__any")  # of two rows


def resolve_one(traces: DataFrame, ref: str) -> str:
    """The id that a reference means; ValueError where it is none's or ambiguous."""
    found = [r[0] for r in resolve(traces, ref).collect()]
    if len(found) != 1:
        raise ValueError(f"{ref!r} is ambiguous: {found}" if found else f"no trace {ref!r}")
    return found[0]


def store_totals(rows: DataFrame) -> DataFrame:
    """One row over the non-forked traces of effective(); sums over nothing stay null."""
    own = rows.where("parent_trace_id is null")
    return own.agg(
        F.count("*").alias("traces"), F.sum("step_count").alias("steps"), F.round(F.avg("duration_ms")).cast("bigint").alias("avg_duration_ms"),
        F.count("duration_ms").alias("measured"), F.sum("effective_tokens").alias("tokens"), F.round(F.sum("total_cost_usd"), 2).alias("cost_usd"),
    )


def store_counts(rows: DataFrame, evals: DataFrame, enabled_policies: int) -> DataFrame:
    """store_totals() with the number of verdicts on these traces, and of enabled policies, which no bound in time narrows."""
    own = rows.where("parent_trace_id is null").select(F.col("id").alias("trace_id"))
    n = evals.join(own, "trace_id", "left_semi").agg(F.count("*").alias("evals"))
    return store_totals(rows).crossJoin(F.broadcast(n)).withColumn("policies", F.lit(enabled_policies).cast("bigint"))  # one row beside one row


def status_counts(traces: DataFrame) -> DataFrame:
    names = traces.sparkSession.createDataFrame(list(enumerate(STATUSES)), "ord int, status string")
    n = traces.where("parent_trace_id is null").groupBy("status").agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def agent_counts(traces: DataFrame) -> DataFrame:
    own = traces.where("parent_trace_id is null")
    return own.groupBy("agent_name").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("failed", "timeout")).alias("failed"))


def top_page(traces: DataFrame, steps: DataFrame, sort: str = "-started_at", limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of effective(). Where the sort key is the trace's own, the page is cut first and only its traces' steps are read."""
    if sort.removeprefix("-") in ("tokens", "duration") or limit < 0:
        return page(effective(traces, steps), sort, limit, offset)
    rows = page(traces, sort, limit, offset)
    few = steps.join(F.broadcast(rows.select(F.col("id").alias("trace_id"))), "trace_id", "left_semi")  # limit ids
    return page(effective(rows, few), sort, limit)


def latest_per(traces: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("started_ms").desc_nulls_last(), F.col("started_at").desc(), F.col("id"))
    return traces.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def abandoned(traces: DataFrame, now_ms: int, after_ms: int = 30 * 60_000) -> DataFrame:
    return traces.where((F.col("status") == "running") & (F.lit(now_ms) - F.col("started_ms") > after_ms))


def step_totals(steps: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Totals of each trace's steps from first to last."""
    inside = F.col("step_number") >= first
    if last is not None:
        inside &= F.col("step_number") <= last
    took = [F.sum("duration_ms").alias("duration_ms")] if "duration_ms" in steps.columns else []
    return steps.where(inside).groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum("tokens_used").alias("tokens"), *took, F.count_if(F.col("error").isNotNull()).alias("errors")
    )
