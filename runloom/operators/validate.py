"""Validation of whole traces and of capture events, each as one row of open JSON, and the tables that valid traces give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.workers import cut
from .browse import STATUSES
from .ingest import STATUS_SYNONYMS, STEP_TYPES

# Vocabularies of the trace model.
TRIGGERS = ("user_message", "cron", "webhook", "api", "manual", "event")
DECIDERS = ("agent", "user", "policy")
EVENT_TYPES = ("trace_start", "step_start", "step_end", "step", "decision", "snapshot", "trace_end")
STEP_EVENTS = ("step_start", "step_end", "step", "decision", "snapshot")
AMOUNTS = ("tokens_used", "duration_ms", "total_tokens", "total_duration_ms", "total_cost_usd")
REFS = ("parent_step", "caused_by_step")
TEXTS = ("agent_version", "started_at", "ended_at", "session_id")
TOTALS = ("total_duration_ms", "total_tokens", "total_cost_usd")
TRACE_FIELDS = ("id", "agent_name", "status", "trigger", "input", "output", "error", "metadata", "tags", *TEXTS, *TOTALS)
STEP_FIELDS = (
    "step_number", "step_type", "name", "input", "output", "error", "metadata", "model", "started_at", "ended_at", "duration_ms", "tokens_used", "decision", "snapshot",
    *(f"{r}{end}" for r in REFS for end in ("", "_number")),
)


def _fault(bad: Column, field: Column | str, message: str) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(bad, F.struct(name.alias("field"), F.lit(message).alias("message")))


def _not_in(v: Column, path: str, allowed: Sequence[str]) -> Column:
    return ~F.coalesce(V.text(v, path).isin(*allowed), F.lit(False))


def _filled(v: Column, path: str) -> Column:
    return F.coalesce(V.text(v, path) != "", F.lit(False))


def _bad_amount(v: Column, path: str) -> Column:
    return V.has(v, path) & ~F.coalesce(V.number(v, path) >= 0, F.lit(False))


def _whole(n: Column) -> Column:
    return n == F.floor(n)


def reference(v: Column, name: str) -> tuple[Column, Column]:
    """(whether a reference is given, its number) under either of its two names."""
    short, long = f"$.{name}", f"$.{name}_number"
    own = V.has(v, short)
    return own | V.has(v, long), F.when(own, V.whole(v, short)).otherwise(V.whole(v, long))


def decision_faults(d: Column, at: Column) -> list[Column]:
    """Faults of a decision under the name at: what was chosen, options, confidence and who decided."""
    named = lambda part: F.concat(at, F.lit(part))
    options = V.items(d, "$.options")
    wrong = lambda test: F.coalesce(F.exists(options, test), F.lit(False))
    return [
        _fault(~V.is_object(d), at, "must be an object"),
        _fault(V.is_object(d) & ~_filled(d, "$.chosen"), named(".chosen"), "is required and must be a string"),
        _fault(V.has(d, "$.confidence") & ~F.coalesce(V.number(d, "$.confidence").between(0, 1), F.lit(False)), named(".confidence"), "must be a number from 0 to 1"),
        _fault(V.has(d, "$.decided_by") & _not_in(d, "$.decided_by", DECIDERS), named(".decided_by"), "is unknown"),
        _fault(V.has(d, "$.options") & options.isNull(), named(".options"), "must be an array"),
        _fault(wrong(lambda o: ~V.is_object(o)), named(".options"), "each must be an object"),
        _fault(wrong(lambda o: V.is_object(o) & ~_filled(o, "$.option")), named(".options"), "each needs an option"),
        _fault(wrong(lambda o: V.has(o, "$.score") & ~V.is_number(o, "$.score")), named(".options"), "a score must be a number"),
    ]


def validate(docs: DataFrame) -> DataFrame:
    """(doc_id, field, message) of every fault of traces (doc_id, body), body being the JSON of one trace with its steps."""
    rows = docs.select("doc_id", V.parsed(F.col("body")).alias("v"))
    # what is read is taken out of a body and of each step at once: a path that is followed, or the kind of a value that holds others, costs as much as the whole
    seen = ("step_number", "step_type", "name", "model", "started_at", "ended_at", "duration_ms", "tokens_used", "decision", *(f"{r}{end}" for r in REFS for end in ("", "_number")))
    own_fields = V.fields(F.col("v"), ("agent_name", "status", "trigger", "tags", *TEXTS, *TOTALS))
    rows = rows.select("doc_id", own_fields.alias("r"), V.listed(F.col("v"), "$.steps", seen).alias("steps"), "v")
    rows = rows.select("doc_id", "r", "steps", (F.col("steps").isNull() & V.has(F.col("v"), "$.steps")).alias("no_list"))
    of, steps, there = (lambda c: F.col(f"r.{c}")), F.col("steps"), F.col("r").isNotNull()
    tags = V.items(of("tags"))
    # numbers of all steps, and what references name: first what is a number, then what is whole, so that each is read once
    numbers = F.filter(F.transform(steps, lambda s: V.number(s["step_number"])), _whole)
    refs = F.flatten(F.transform(steps, lambda s: F.array(*(F.when(V.has(s[r], "$"), V.number(s[r])).otherwise(V.number(s[f"{r}_number"])) for r in REFS))))
    rows = rows.select("*", numbers.alias("numbers"), F.filter(refs, lambda n: (n >= 1) & _whole(n)).alias("named"))
    faults = (
        _fault(~there, "root", "must be an object"),
        _fault(there & ~_filled(of("agent_name"), "$"), "agent_name", "is required and must be a string"),
        _fault(V.has(of("status"), "$") & _not_in(of("status"), "$", STATUSES), "status", "is unknown"),
        _fault(V.has(of("trigger"), "$") & _not_in(of("trigger"), "$", TRIGGERS), "trigger", "is unknown"),
        *(_fault(_bad_amount(of(c), "$"), c, "must be a finite number of 0 or more") for c in TOTALS),
        _fault(V.has(of("tags"), "$") & tags.isNull(), "tags", "must be an array"),
        _fault(F.coalesce(F.exists(tags, lambda t: ~V.is_text(t)), F.lit(False)), "tags", "must all be strings"),
        *(_fault(V.has(of(c), "$") & ~V.is_text(of(c)), c, "must be a string") for c in TEXTS),
        _fault(F.col("no_list"), "steps", "must be an array"),
        _fault(F.coalesce(F.size("numbers") > F.size(F.array_distinct("numbers")), F.lit(False)), "steps", "a step_number appears more than once"),
    )
    lost = F.array_except("named", "numbers")  # what references name and no step has
    # one pass: the faults of the whole go with the first step, or alone where there is none
    each = rows.select("doc_id", F.array(*faults).alias("whole"), lost.alias("lost"), F.posexplode_outer(steps).alias("i", "s"))
    s, at = (lambda c: F.col(f"s.{c}")), F.concat(F.lit("steps["), F.col("i").cast("string"), F.lit("]."))
    named = lambda part: F.concat(at, F.lit(part))
    is_step, own = F.col("s").isNotNull(), F.col("own")
    given, ref = {}, {}
    for name in REFS:
        short = V.has(s(name), "$")
        given[name] = short | V.has(s(f"{name}_number"), "$")
        ref[name] = F.when(short, V.number(s(name))).otherwise(V.number(s(f"{name}_number")))
    each = each.select("*", V.number(s("step_number")).alias("own"), *(c.alias(f"given_{n}") for n, c in given.items()), *(c.alias(f"ref_{n}") for n, c in ref.items()))
    each = each.withColumns({c: F.when(_whole(F.col(c)), F.col(c)) for c in ("own", *(f"ref_{n}" for n in REFS))})
    step_refs = []
    for name in REFS:
        ref = F.col(f"ref_{name}")
        step_refs += [
            _fault(F.col(f"given_{name}") & ~F.coalesce(ref >= 1, F.lit(False)), named(name), "must be a positive whole number"),
            _fault((ref >= 1) & (ref >= own), named(name), "must name an earlier step"),
            _fault((ref >= 1) & F.array_contains("lost", ref), named(name), "names a step that is not there"),
        ]
    step_faults = F.array(
        _fault(~is_step, named("root"), "must be an object"),
        _fault(is_step & ~F.coalesce(own >= 1, F.lit(False)), named("step_number"), "is required and must be a positive whole number"),
        _fault(is_step & _not_in(s("step_type"), "$", STEP_TYPES), named("step_type"), "is required and must be known"),
        _fault(is_step & ~_filled(s("name"), "$"), named("name"), "is required and must be a string"),
        *(_fault(V.has(s(c), "$") & ~V.is_text(s(c)), named(c), "must be a string") for c in ("model", "started_at", "ended_at")),
        *(_fault(_bad_amount(s(c), "$"), named(c), "must be a finite number of 0 or more") for c in ("duration_ms", "tokens_used")),
        *step_refs,
        *(F.when(V.has(s("decision"), "$"), f) for f in decision_faults(s("decision"), named("decision"))),
    )
    # the faults are a column of their own and nulls go afterwards: inside a lambda nothing is compiled, nor is what is asked twice read once
    first = F.when(F.col("i").isNull() | (F.col("i") == 0), F.col("whole"))
    found = each.select("doc_id", first.alias("whole"), F.when(F.col("i").isNotNull(), step_faults).alias("own"))
    found = found.select("doc_id", F.explode(F.array("whole", "own")).alias("x")).select("doc_id", F.explode("x").alias("x")).where("x is not null")
    return found.select("doc_id", "x.field", "x.message")


def trace_id(v: Column, doc_id: Column, body: Column, salt: str = "") -> Column:
    """The trace's own id where it is a string that is not blank; else one made from where the trace stands and what it says, so that equal bodies are traces of their own."""
    return _own_id(F.try_variant_get(v, "$.id", "variant"), doc_id, body, salt)


def _own_id(own: Column, doc_id: Column, body: Column, salt: str) -> Column:
    made = F.concat(F.lit("trc_"), F.substring(F.sha2(F.concat_ws("\n", F.lit(salt), doc_id.cast("string"), body), 256), 1, 16))
    return F.coalesce(F.when(F.trim(V.text(own)) != "", V.text(own)), made)


def tables(docs: DataFrame, extra_tags: Sequence[str] = (), salt: str = "", valid: bool = False) -> dict[str, DataFrame]:
    """traces, steps, decisions and snapshots of the traces (doc_id, body) that have no fault, or of all where they are known to be valid. A trace
    without an id gets one of its own; salt tells those of one delivery from those of another."""
    if not valid:
        docs = docs.join(validate(docs).select("doc_id").distinct(), "doc_id", "left_anti")
        docs = cut(docs)  # what is left is read for each of the tables
    rows = docs.select("doc_id", "body", V.parsed(F.col("body")).alias("v"))
    rows = rows.select("doc_id", "body", V.fields(F.col("v"), TRACE_FIELDS).alias("r"), V.listed(F.col("v"), "$.steps", STEP_FIELDS).alias("steps"))
    r, s = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"s.{c}"))
    none = F.array().cast("array<string>")
    tags = F.coalesce(F.try_variant_get(r("tags"), "$", "array<string>"), none)
    traces = rows.select(
        _own_id(r("id"), F.col("doc_id"), F.col("body"), salt).alias("id"), V.text(r("agent_name")).alias("agent_name"),
        V.text(r("agent_version")).alias("agent_version"), F.coalesce(V.text(r("trigger")), F.lit("manual")).alias("trigger"),
        F.coalesce(V.text(r("status")), F.when(V.has(r("ended_at"), "$"), "completed").otherwise("running")).alias("status"),
        F.coalesce(V.payload(r("input")), F.lit("{}")).alias("input"), V.payload(r("output")).alias("output"),
        *(V.text(r(c)).alias(c) for c in ("started_at", "ended_at", "session_id")),
        *(V.number(r(c)).cast(t).alias(c) for c, t in (("total_duration_ms", "bigint"), ("total_tokens", "bigint"), ("total_cost_usd", "double"))),
        F.coalesce(V.text(r("error")), V.json(r("error"))).alias("error"), F.array_distinct(F.concat(tags, F.lit(list(extra_tags)).cast("array<string>"))).alias("tags"),
        F.coalesce(V.json(r("metadata")), F.lit("{}")).alias("metadata"), F.lit(None).cast("string").alias("parent_trace_id"),
        F.posexplode_outer(F.coalesce("steps", F.array().cast(rows.schema["steps"].dataType))).alias("i", "s"),
    )
    whole = lambda c: V.whole(s(c)).cast("int")
    parts = traces.where("i is not null").select(F.col("id").alias("trace_id"), whole("step_number").alias("step_number"), "s")
    decision, snapshot = s("decision"), s("snapshot")
    return {
        "traces": traces.where("i is null or i = 0").drop("i", "s"),
        "steps": parts.select(
            "trace_id", "step_number", V.text(s("step_type")).alias("step_type"), V.text(s("name")).alias("name"),
            F.coalesce(V.payload(s("input")), F.lit("{}")).alias("input"), V.payload(s("output")).alias("output"),
            *(V.text(s(c)).alias(c) for c in ("started_at", "ended_at", "model")),
            *(V.number(s(c)).cast("bigint").alias(c) for c in ("duration_ms", "tokens_used")),
            F.coalesce(V.text(s("error")), V.json(s("error"))).alias("error"), F.coalesce(V.json(s("metadata")), F.lit("{}")).alias("metadata"),
            *(F.when(V.has(s(n), "$"), whole(n)).otherwise(whole(f"{n}_number")).alias(f"{n}_number") for n in REFS),
        ),
        "decisions": parts.where(V.has(decision, "$")).select(
            "trace_id", "step_number", F.coalesce(V.json(decision, "$.options"), F.lit("[]")).alias("options"), V.text(decision, "$.chosen").alias("chosen"),
            V.text(decision, "$.rationale").alias("rationale"), V.number(decision, "$.confidence").alias("confidence"),
            F.coalesce(V.text(decision, "$.decided_by"), F.lit("agent")).alias("decided_by"),
        ),
        "snapshots": parts.where(V.has(snapshot, "$")).select(
            "trace_id", "step_number", *(F.coalesce(V.json(snapshot, f"$.{c}"), F.lit("{}")).alias(c) for c in ("context_window", "environment", "tool_state")),
            F.coalesce(V.number(snapshot, "$.token_count").cast("bigint"), F.lit(0)).alias("token_count"),
        ),
    }


def read_events(lines: DataFrame) -> DataFrame:
    """(seq, event, type, trace_id, step_number, status, warning, repaired) of capture events (seq, line); event is null where one is skipped.

    Amounts that can't be used and references that don't point backwards are taken out and named in the warning; a status is read by its
    synonyms, and one that can't be read counts as failed and repaired. Other columns of lines come last.
    """
    more = [c for c in lines.columns if c not in ("seq", "line")]
    v = F.col("v")
    kind_ = V.text(v, "$.type")
    of = lambda *names: kind_.isin(*names)
    status = V.text(v, "$.status")
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_SYNONYMS.items() for x in kv)), F.lower(F.trim(status)))
    ends = of("trace_end") & V.has(v, "$.status")
    step = V.whole(v, "$.step_number")
    decided = F.when(of("decision"), v).when(of("step"), F.try_variant_get(v, "$.decision", "variant"))
    some = lambda x: F.coalesce(x, F.lit(False))
    bad_option = lambda o: ~V.is_object(o) | ~_filled(o, "$.option") | (V.has(o, "$.score") & ~V.is_number(o, "$.score"))
    skips = [
        (~V.is_object(v), "must be an object"),
        (~some(of(*EVENT_TYPES)), "unknown event type"),
        (V.has(v, "$.v") & ~some(V.number(v, "$.v") == 1), "unsupported version"),
        (of("trace_start") & ~_filled(v, "$.agent_name"), "agent_name is missing"),
        (~of("trace_start") & ~_filled(v, "$.trace_id"), "trace_id is missing"),
        (some((F.trim(V.text(v, "$.trace_id")) == "") | V.text(v, "$.trace_id").rlike(r"[\x00-\x1f\x7f-\x9f]")), "trace_id can't be used"),
        (of(*STEP_EVENTS) & ~some(step >= 1), "step_number must be a positive whole number"),
        (of("step_start", "step") & ~_filled(v, "$.name"), "name is missing"),
        (of("step_start", "step") & _not_in(v, "$.step_type", STEP_TYPES), "step_type is unknown"),
        (V.has(v, "$.tags") & ~some(~F.exists(V.items(v, "$.tags"), lambda t: ~V.is_text(t))), "tags must all be strings"),
        (of("decision") & ~_filled(v, "$.chosen"), "chosen is missing"),
        (some(V.has(decided, "$.confidence") & ~some(V.number(decided, "$.confidence").between(0, 1))), "confidence must lie in 0 to 1"),
        (some(V.has(decided, "$.options") & V.items(decided, "$.options").isNull()), "options must be an array"),
        (some(F.exists(V.items(decided, "$.options"), bad_option)), "an option can't be used"),
        (of("step") & V.has(v, "$.decision") & ~_filled(v, "$.decision.chosen"), "chosen is missing"),
    ]
    skip = F.coalesce(*(F.when(bad, F.lit(f"skipped: {why}")) for bad, why in skips))
    dropped = [F.when(_bad_amount(v, f"$.{c}"), F.lit(c)) for c in AMOUNTS]
    refs = [F.when(V.has(v, f"$.{c}") & ~some((V.whole(v, f"$.{c}") >= 1) & (V.whole(v, f"$.{c}") < step)) & step.isNotNull(), F.lit(c)) for r in REFS for c in (r, f"{r}_number")]
    rows = lines.select("seq", F.col("line").alias("event"), V.parsed(F.col("line")).alias("v"), *more)
    rows = rows.select(
        "seq", "event", kind_.alias("type"), V.text(v, "$.trace_id").alias("trace_id"), step.cast("int").alias("step_number"),
        F.when(ends, F.coalesce(known, F.lit("failed"))).when(of("trace_end"), "completed").alias("status"), skip.alias("skip"),
        (ends & known.isNull()).alias("repaired"), F.array_compact(F.array(*dropped, *refs)).alias("out"),
        F.when(ends & known.isNull(), F.lit("status is recorded as failed")).when(ends & (known != status), F.concat(F.lit("status is read as "), known)).alias("read"), *more,
    )
    out = F.when(F.size("out") > 0, F.concat(F.lit("ignored "), F.array_join("out", ", ")))
    fine = F.col("skip").isNull()
    return rows.select(
        "seq", F.when(fine, F.col("event")).alias("event"), "type", "trace_id", "step_number", F.when(fine, F.col("status")).alias("status"),
        F.coalesce("skip", F.nullif(F.concat_ws("; ", "read", out), F.lit(""))).alias("warning"), (fine & F.col("repaired")).alias("repaired"), "out", *more,
    )


def fold(events: DataFrame) -> dict[str, DataFrame]:
    """traces, steps and decisions of read_events(): for each field the last event that gives it counts, an explicit null too.

    A step begins with step_start or step while its trace runs, a second one of its number is refused; step_end changes any step that is there, after the
    trace's end as well; a trace that is not ended is a timeout. Decisions and totals replace earlier ones.
    """
    rows = cut(events.where("event is not null and trace_id is not null")).withColumn("v", V.parsed(F.col("event")))
    v = F.col("v")
    before = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    began = F.coalesce(F.max(F.col("type") == "trace_start").over(before), F.lit(False))
    ended = F.coalesce(F.max(F.col("type") == "trace_end").over(before), F.lit(False))
    rows = rows.withColumn("began", began | (F.col("type") == "trace_start")).withColumn("late", ended).where("began")
    opens = F.col("type").isin("step_start", "step") & ~F.col("late")
    first = F.min(F.when(opens, F.col("seq"))).over(Window.partitionBy("trace_id", "step_number"))
    rows = rows.withColumn("first", F.when(F.col("step_number").isNotNull(), first))
    rows = rows.where("step_number is null or (seq = first) or (seq > first and type not in ('step_start', 'step'))")
    given = lambda c: F.try_variant_get(v, f"$.{c}", "variant").isNotNull() & ~F.array_contains("out", c)
    last = lambda c, value, *types: F.max_by(value, F.when(F.col("type").isin(*types) & given(c), F.col("seq"))).alias(c)
    pointed = lambda r: reference(v, r)[0] & ~F.array_contains("out", r) & ~F.array_contains("out", f"{r}_number")
    step = ("step_start", "step", "step_end")
    own = rows.where(F.col("type").isin(*step)).groupBy("trace_id", "step_number").agg(
        last("step_type", V.text(v, "$.step_type"), "step_start", "step"), last("name", V.text(v, "$.name"), "step_start", "step"),
        F.coalesce(last("input", V.payload(v, "$.input"), "step_start", "step"), F.lit("{}")).alias("input"), last("output", V.payload(v, "$.output"), "step", "step_end"),
        last("error", F.coalesce(V.text(v, "$.error"), V.json(v, "$.error")), "step", "step_end"), last("model", V.text(v, "$.model"), *step),
        last("tokens_used", V.number(v, "$.tokens_used").cast("bigint"), "step", "step_end"), last("duration_ms", V.number(v, "$.duration_ms").cast("bigint"), "step", "step_end"),
        *(F.max_by(reference(v, r)[1].cast("int"), F.when(F.col("type").isin("step_start", "step") & pointed(r), F.col("seq"))).alias(f"{r}_number") for r in REFS),
    )
    chosen = F.col("type").isin("decision") | ((F.col("type") == "step") & V.has(v, "$.decision"))
    d = F.when(F.col("type") == "decision", v).otherwise(F.try_variant_get(v, "$.decision", "variant"))
    decided = rows.where(chosen).groupBy("trace_id", "step_number").agg(
        F.max_by(F.struct(
            F.coalesce(V.json(d, "$.options"), F.lit("[]")).alias("options"), V.text(d, "$.chosen").alias("chosen"), V.text(d, "$.rationale").alias("rationale"),
            V.number(d, "$.confidence").alias("confidence"), F.coalesce(V.text(d, "$.decided_by"), F.lit("agent")).alias("decided_by"),
        ), "seq").alias("d")
    ).select("trace_id", "step_number", "d.*")
    at = lambda c, value, *types: F.max_by(value, F.when(F.col("type").isin(*types) & V.has(v, f"$.{c}") & ~F.array_contains("out", c), F.col("seq"))).alias(c)
    traces = rows.groupBy("trace_id").agg(
        at("agent_name", V.text(v, "$.agent_name"), "trace_start"), at("input", V.payload(v, "$.input"), "trace_start"),
        F.max_by("status", F.when(F.col("type") == "trace_end", F.col("seq"))).alias("status"), at("output", V.payload(v, "$.output"), "trace_end"),
        at("error", F.coalesce(V.text(v, "$.error"), V.json(v, "$.error")), "trace_end"),
        at("total_tokens", V.number(v, "$.total_tokens").cast("bigint"), "trace_end"), at("total_cost_usd", V.number(v, "$.total_cost_usd"), "trace_end"),
    )
    return {"traces": traces.withColumn("status", F.coalesce("status", F.lit("timeout"))), "steps": own, "decisions": decided}
