"""A trace store: versioned Parquet tables for traces, steps, decisions, snapshots, verdicts, spans and policies, that batches and patches are merged into."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsons, times
from ..functions import variants as V
from ..functions.workers import cut
from ..operators import graph, imports, ingest, judge, otlp, records, validate
from ..operators.ingest import STEP_TYPES
from .versions import Snapshot, VersionedTables

SCHEMAS = {
    "traces": "id string, agent_name string, agent_version string, trigger string, status string, input string, output string, started_at string,"
    " ended_at string, session_id string, total_duration_ms bigint, total_tokens bigint, total_cost_usd double, error string, tags array<string>,"
    " metadata string, parent_trace_id string",
    "steps": "trace_id string, step_number int, step_type string, name string, input string, output string, started_at string, ended_at string,"
    " model string, duration_ms bigint, tokens_used bigint, error string, metadata string, parent_step_number int, caused_by_step_number int",
    "decisions": "trace_id string, step_number int, options string, chosen string, rationale string, confidence double, decided_by string",
    "snapshots": "trace_id string, step_number int, context_window string, environment string, tool_state string, token_count bigint",
    "evals": "trace_id string, evaluator_type string, evaluator_name string, score double, passed boolean, details string, evaluated_ms bigint, seq bigint",
    "spans": "trace_id string, span_id string, parent_id string, otel_trace_id string, alias string, batch bigint, place string, name string, step_type string, start_ms bigint,"
    " end_ms bigint, tokens bigint, cost_usd double, error string, service string, step_name string, model string, input string, output string, metadata string, agent string, session_id string",
    "aliases": "id string, trace_id string, started_at string",
    "policies": "name string, action string, priority int, enabled boolean, pattern string",
}


KEYS = {n: "id" if n in ("traces", "aliases") else "name" if n == "policies" else "trace_id" for n in SCHEMAS}
OWN = ("traces", "steps", "decisions", "snapshots", "evals", "spans")  # what goes with a trace
AMOUNTS = ("duration_ms", "tokens_used", "total_duration_ms", "total_tokens", "total_cost_usd")


def _fixed(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One row a key: the first by order, or else by all its values."""
    least = F.min(F.struct(*([order] if order else []), *(c for c in rows.columns if c != order and c not in key)))
    return rows.groupBy(*key).agg(least.alias("__x")).select(*key, *(F.col(f"__x.{c}").alias(c) for c in rows.columns if c not in key and c != order))


class TraceStore(VersionedTables):
    """Traces with all that belongs to them, divided by trace. Every method is one change: it is there whole, or not at all."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        super().__init__(spark, root, SCHEMAS, KEYS, buckets)

    def table(self, name: str) -> DataFrame:
        """The table as it is now, without rows where none was written."""
        return self.snapshot().table(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.change(lambda snap: {name: (rows, None)})

    def trace(self, name: str, *ids: str) -> DataFrame:
        """The rows of these traces: a keyed read of one bucket a trace."""
        snap, key = self.snapshot(), KEYS[name]
        return snap.near(name, self.spark.createDataFrame([(i,) for i in ids], "id string")).where(F.col(key).isin(*ids))

    def ingest(self, docs: DataFrame, extra_tags: Sequence[str] = ()) -> DataFrame:
        """Writes the traces (doc_id, body) that have no fault; the faults of the others are returned (doc_id, field, message).

        An id that is stored already, or that an earlier doc_id has, is a fault. A trace without an id (absent, blank or no string) gets one of its own.
        """
        salt = uuid.uuid4().hex
        faults = cut(validate.validate(docs))
        good = docs.join(faults.select("doc_id").distinct(), "doc_id", "left_anti")
        named = cut(good.select("doc_id", validate.trace_id(V.parsed(F.col("body")), F.col("doc_id"), F.col("body"), salt).alias("id")))
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            stored = snap.near("traces", named.select("id")).select("id")
            first = named.groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(stored, "id", "left_anti")
            new = cut(first.select("doc_id"))
            out[:] = [named.join(new, "doc_id", "left_anti").select("doc_id", F.lit("id").alias("field"), F.lit("is taken").alias("message"))]
            parts = validate.tables(good.join(new, "doc_id", "left_semi"), extra_tags, salt, valid=True)
            return {n: (rows, None) for n, rows in parts.items()} | {"aliases": (self._aliases(parts["traces"]), None)}

        self.change(work)
        return faults.union(out[0].select(*faults.columns))

    def ingest_files(self, path: str, extra_tags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """ingest() of JSON and JSON lines files; (faults, lines that are no JSON: file, n)."""
        docs, bad = imports.documents(imports.read_lines(self.spark, path))
        return self.ingest(docs, extra_tags), bad

    @staticmethod
    def _aliases(traces: DataFrame) -> DataFrame:
        """(id, trace_id, started_at): what later batches find a trace by, its telemetry id, or its session and format. Forks have none."""
        meta = lambda k: F.get_json_object("metadata", f"$.{k}")
        otel, fmt = meta("otel_trace_id"), meta("source_format")
        keys = F.array_compact(F.array(F.concat(F.lit("otel:"), otel), F.when(otel.isNull(), F.concat(F.lit("session:"), F.col("session_id"), F.lit(":"), fmt))))
        return traces.where("parent_trace_id is null").select(F.explode(keys).alias("id"), F.col("id").alias("trace_id"), "started_at")

    def start(self, traces: DataFrame) -> DataFrame:
        """Opens traces (id or none, agent_name, ...) as running; faults (id, message) of those whose id is taken. Of several with an id one is opened."""
        made = F.concat(F.lit("trc_"), F.substring(F.sha2(F.uuid(), 256), 1, 16))
        own = F.col("id") if "id" in traces.columns else F.lit(None).cast("string")
        running = {"id": F.coalesce(F.when(F.trim(own) != "", own), made), "status": F.lit("running")}
        given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in traces.columns else F.lit(default)
        running |= {"trigger": given("trigger", "manual"), "input": given("input", "{}"), "metadata": given("metadata", "{}")}
        running["tags"] = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in traces.columns else F.array().cast("array<string>")
        running["parent_trace_id"] = F.col("parent_trace_id") if "parent_trace_id" in traces.columns else F.lit(None).cast("string")
        more = {c: F.lit(None).cast("string") for c in ("session_id", "started_at") if c not in traces.columns}
        rows = cut(_fixed(cut(traces.withColumns(running | more)), ["id"], None))  # ids are drawn once
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            taken = cut(snap.near("traces", rows.select("id")).select("id").join(rows, "id", "left_semi"))
            out[:] = [taken.select("id", F.lit("id is taken").alias("message"))]
            new = rows.join(taken, "id", "left_anti")
            return {"traces": (new, None), "aliases": (self._aliases(new), None)}

        self.change(work)
        return out[0]

    def append_steps(self, steps: DataFrame) -> DataFrame:
        """Adds steps (trace_id, step_number, step_type, name, ..., seq or none) to running traces; faults (trace_id, step_number, message) of the others.

        Of several with one number the first by seq is added. References that don't point to an earlier number are dropped.
        """
        key = records.KEY
        rows = cut(steps)
        firsts = _fixed(rows, key, "seq" if "seq" in rows.columns else None)
        more = {c: F.lit(None).cast("int") for c in ("parent_step_number", "caused_by_step_number") if c not in firsts.columns}
        some = lambda c: F.coalesce(F.col(c), F.lit("{}")) if c in firsts.columns else F.lit("{}")
        firsts = graph.drop_forward_refs(firsts.withColumns(more | {"input": some("input"), "metadata": some("metadata")}))
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            touched = self.touched(rows.select("trace_id"))
            status = snap.table("traces", touched).select(F.col("id").alias("trace_id"), "status")
            have = snap.table("steps", touched).select(*key, F.lit(True).alias("__have"))
            judged = firsts.join(status, "trace_id", "left").join(have, key, "left")
            why = F.coalesce(
                F.when(F.col("status").isNull(), F.lit("no such trace")), F.when(F.col("status") != "running", F.concat(F.lit("the trace is "), "status")),
                F.when(~F.coalesce(F.col("step_number") >= 1, F.lit(False)), F.lit("step_number must be positive")), F.when(F.col("__have"), F.lit("step_number is taken")),
                F.when(~F.coalesce(F.col("step_type").isin(*STEP_TYPES), F.lit(False)), F.lit("step_type is unknown")),
                F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("name is missing")),
            )
            judged = cut(judged.withColumn("message", why))
            more_ = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("step_number is given more than once").alias("message"))
            out[:] = [judged.where("message is not null").select(*key, "message").union(more_)]
            return {"steps": (judged.where("message is null").drop("status", "__have", "message"), None)}

        self.change(work)
        return out[0]

    def patch(self, name: str, patches: DataFrame) -> DataFrame:
        """Changes traces (id, patch, seq) or steps (trace_id, step_number, patch, seq): of each field that a JSON patch gives, null too, the value
        of the highest seq takes its place. A trace need not be running; a status is read by its synonyms, one that can't be read means failed. Faults (key, message) of
        rows that are not there."""
        key = ["id"] if name == "traces" else records.KEY
        free = [f for f in self.spark.createDataFrame([], SCHEMAS[name]).schema.fields if f.name not in (*key, "parent_trace_id")]
        rows = cut(patches).withColumn("v", V.parsed(F.col("patch")))
        v = F.col("v")

        def value(f) -> Column:
            at = f"$.{f.name}"
            if f.name == "status":
                return F.when(V.has(v, at), ingest.status_of(F.coalesce(V.text(v, at), F.lit("")))[0])
            if f.name in AMOUNTS:
                return F.when(V.number(v, at) >= 0, V.number(v, at)).cast(f.dataType)
            if f.name in ("parent_step_number", "caused_by_step_number"):
                return F.when((V.whole(v, at) >= 1) & (V.whole(v, at) < F.col("step_number")), V.whole(v, at)).cast("int")
            if f.name == "tags":
                return F.try_variant_get(v, at, "array<string>")
            if f.name in ("input", "output", "metadata"):
                return V.payload(v, at)
            return F.coalesce(V.text(v, at), V.json(v, at))

        given = lambda f: F.when(F.try_variant_get(v, f"$.{f.name}", "variant").isNotNull(), F.col("seq"))
        folded = rows.groupBy(*key).agg(*(F.max_by(F.struct(value(f).alias("v")), given(f)).alias(f"__{f.name}") for f in free), F.lit(True).alias("__patched"))
        folded = cut(folded)
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            touched = self.touched(folded.select(key[0]))
            old = snap.table(name, touched)
            both = old.join(folded, key, "left")
            kept = {"status": "running", "input": "{}", "metadata": "{}"}  # what a null leaves
            new = lambda f: F.coalesce(F.col(f"__{f.name}.v"), F.lit(kept[f.name])) if f.name in kept else F.col(f"__{f.name}.v")
            of = {f.name: F.when(F.col(f"__{f.name}").isNotNull(), new(f)).otherwise(F.col(f.name)).alias(f.name) for f in free}
            out[:] = [folded.join(old, key, "left_anti").select(*key, F.lit("is not there").alias("message"))]
            return {name: (both.select(*(of.get(c, c) for c in old.columns)), touched)}

        self.change(work)
        return out[0]

    def attach(self, name: str, rows: DataFrame) -> DataFrame:
        """Puts decisions or snapshots (trace_id, step_number, ..., seq or none) on steps that are there, in the place of earlier ones; faults of the others."""
        key = records.KEY
        new = cut(records.attached(rows).drop("seq") if "seq" in rows.columns else _fixed(rows, key, None))
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            touched = self.touched(new.select("trace_id"))
            there = snap.table("steps", touched).select(*key)
            out[:] = [new.join(there, key, "left_anti").select(*key, F.lit("no such step").alias("message"))]
            put = new.join(there, key, "left_semi")
            return {name: (snap.table(name, touched).join(put, key, "left_anti").unionByName(put, allowMissingColumns=True), touched)}

        self.change(work)
        return out[0]

    def fork(self, points: DataFrame, started_at: str, input: str | None = None, context: str | None = None, tag: str | None = None) -> DataFrame:
        """Forks traces at points (id, at) as graph.forks() does; faults (id, at, message)."""
        asked, salt = cut(points.select("id", "at")), uuid.uuid4().hex
        out: list[DataFrame] = []

        def work(snap: Snapshot) -> dict:
            touched = self.touched(asked.select("id"))
            tables = {n: snap.table(n, touched) for n in ("traces", "steps", "decisions", "snapshots")}
            made, faults = graph.forks(tables, asked, started_at, salt, input, context, tag)
            out[:] = [faults]
            return {n: (rows, None) for n, rows in made.items()}

        self.change(work)
        return out[0]

    def merge_spans(self, spans: DataFrame, source_format: str = "otel", lying: bool = False) -> None:
        """Upserts a batch of otlp.read_spans(): every span once, in whichever batch it came first, into the trace that has its telemetry id, or else its session and this format
        (no fork; the earliest), or into a new one.

        Steps and trace are made anew from all spans of the traces that the batch touches, so any cut and repetition of batches gives the same rows; steps that came
        another way keep their numbers, and the spans' follow them. What a trace holds already wins: its agent, prompt, output and metadata are kept unless it has none, or
        was synthetic (opened by spans without a root). A trace of whose spans the batch brings none for the first time stays as it is.

        lying: the spans lie in files, so that to read them twice is cheaper than a copy of them.
        """
        key = F.when(~F.col("trace_id").startswith("!"), F.concat(F.lit("otel:"), "trace_id")).when(
            F.col("session_id").isNotNull(), F.concat(F.lit("session:"), "session_id", F.lit(f":{source_format}"))
        )
        folder = uuid.uuid4().hex
        rows = spans.select(
            F.coalesce(key, F.concat(F.lit("one:"), "trace_id")).alias("alias"), F.concat_ws(".", *(F.lpad(F.col(f"seq.{c}").cast("string"), 20, "0") for c in ("seq", "i", "j", "k"))).alias("place"),
            F.col("trace_id").alias("otel_trace_id"), *(c for c in spans.columns if c not in ("seq", "trace_id")),
        )
        rows = rows if lying else self.interim(folder, rows)
        aliases = self.interim(folder, rows.select("alias").distinct())

        def work(snap: Snapshot) -> dict:
            known = snap.near("aliases", aliases).groupBy(F.col("id").alias("alias")).agg(
                F.min_by("trace_id", F.struct(F.coalesce(times.instant_ms(F.col("started_at")), F.lit(2**62)), "trace_id")).alias("target")
            )
            named = F.coalesce("target", F.concat(F.lit("trc_"), F.substring(F.sha2("alias", 256), 1, 16)))
            names = self.interim(folder, aliases.join(known, "alias", "left").select("alias", named.alias("trace_id")))
            put = rows.join(names, "alias")
            had = snap.near("spans", names.select("trace_id")).select("trace_id", "span_id")
            ids = self.interim(folder, put.select("trace_id", "span_id").join(had, ["trace_id", "span_id"], "left_anti").select("trace_id").distinct())
            touched = self.touched(ids)
            if not touched:
                return {}
            put = put.join(ids, "trace_id", "left_semi")
            old = {n: snap.table(n, touched) for n in ("spans", "steps", "traces")}
            mine, others = "left_semi", "left_anti"
            # what came first stays, so a span that comes again changes nothing
            batch = F.lit(snap.version)
            every = old["spans"].join(ids, "trace_id", mine).unionByName(put.withColumn("batch", batch), allowMissingColumns=True)
            w = Window.partitionBy("trace_id", "span_id").orderBy("batch", "place")
            every = every.repartition("trace_id").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
            # the table's new segment is what steps and traces are made of, so that no copy of it is stored beside it
            kept = self.written("spans", old["spans"].join(ids, "trace_id", others).unionByName(every))
            placed = kept.rows.join(ids, "trace_id", mine).withColumn("seq", F.struct("batch", "place"))
            spanned = F.get_json_object("metadata", "$.otel_span_id").isNotNull()
            own = old["steps"].join(ids, "trace_id", mine).where(~spanned)
            last = own.groupBy("trace_id").agg(F.max("step_number").alias("__last"))
            base = F.coalesce("__last", F.lit(0))
            steps = otlp.span_steps(placed).join(last, "trace_id", "left").withColumns({"step_number": F.col("step_number") + base, "parent_step_number": F.col("parent_step_number") + base}).drop("__last")
            steps = old["steps"].join(ids, "trace_id", others).unionByName(own).unionByName(steps, allowMissingColumns=True)
            before = old["traces"].join(ids.withColumnRenamed("trace_id", "id"), "id", mine)
            traces = self._merged(before, placed, source_format)
            fresh = traces.join(before.select("id"), "id", others)
            return {
                "spans": (kept, touched), "steps": (steps, touched),
                "traces": (old["traces"].join(ids.withColumnRenamed("trace_id", "id"), "id", others).unionByName(traces), touched), "aliases": (self._aliases(fresh), None),
            }

        try:
            self.change(work)
        finally:
            self.forget(folder)

    @staticmethod
    def _merged(before: DataFrame, spans: DataFrame, source_format: str) -> DataFrame:
        """The rows of the traces of all these spans, with what was there before them."""
        said = otlp.span_traces(spans)
        total = ingest.assemble_spans(otlp.as_assembly(spans))
        first = spans.groupBy("trace_id").agg(F.min("otel_trace_id").alias("otel"), F.max("end_ms").alias("end_ms"))
        new = said.join(total, "trace_id").join(first, "trace_id").select(F.col("trace_id").alias("id"), *(F.col(c).alias(f"__{c}") for c in (*said.columns[1:], *total.columns[1:], *first.columns[1:])))
        both = new.join(before, "id", "left")
        meta = V.parsed(F.coalesce("metadata", F.lit("{}")))
        fact = lambda k: F.try_variant_get(meta, f"$.{k}", "double")
        absent = F.col("agent_name").isNull()
        own = absent | F.coalesce(F.try_variant_get(meta, "$.synthetic_trace", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(meta, "$.otel_opened", "boolean"), F.lit(False))
        tokens, cost = (F.when(own, F.lit(0.0)).otherwise(F.coalesce(fact(f"otel_base_{k}"), F.col(c).cast("double"), F.lit(0.0))) for k, c in (("tokens", "total_tokens"), ("cost", "total_cost_usd")))
        keep = lambda c, new: F.when(own, F.coalesce(new, c)).otherwise(F.coalesce(c, new))
        begun = F.least(times.instant_ms(F.col("started_at")), F.col("__start_ms"))
        ended = F.greatest(times.instant_ms(F.col("ended_at")), F.col("__end_ms"))
        iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        took = ended - begun
        facts = F.to_json(F.struct(
            F.when(~F.col("__otel").startswith("!"), F.col("__otel")).alias("otel_trace_id"), F.lit(source_format).alias("source_format"), F.when(own, F.lit(True)).alias("otel_opened"),
            F.when(own & F.col("__synthetic"), F.lit(True)).alias("synthetic_trace"), F.when(~own, tokens).alias("otel_base_tokens"), F.when(~own, cost).alias("otel_base_cost"),
        ))
        facts = F.map_filter(jsons.merged(facts, F.coalesce("metadata", F.lit("{}"))), lambda k, x: ~((k == "synthetic_trace") & own & ~F.col("__synthetic")))
        prompt = F.when(F.col("input") != "{}", F.col("input"))
        return both.select(
            "id", keep("agent_name", F.col("__agent_name")).alias("agent_name"), "agent_version", F.coalesce("trigger", F.lit("api")).alias("trigger"),
            F.when((F.col("status") == "failed") & ~own, "failed").when(F.col("__status") == "failed", "failed").otherwise(F.when(own, F.col("__status")).otherwise(F.col("status"))).alias("status"),
            F.coalesce(F.when(own, F.coalesce("__input", prompt)).otherwise(F.coalesce(prompt, "__input")), F.lit("{}")).alias("input"), keep("output", F.col("__output")).alias("output"),
            F.coalesce(iso(begun), "started_at").alias("started_at"), F.coalesce(iso(ended), "ended_at").alias("ended_at"), F.coalesce("session_id", "__session_id").alias("session_id"),
            F.when(took >= 0, took).otherwise(F.col("total_duration_ms")).alias("total_duration_ms"), F.nullif((tokens + F.coalesce("__tokens", F.lit(0))).cast("bigint"), F.lit(0)).alias("total_tokens"),
            F.nullif(cost + F.coalesce("__cost_usd", F.lit(0.0)), F.lit(0.0)).alias("total_cost_usd"), "error", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            F.to_json(facts).alias("metadata"), "parent_trace_id",
        )

    def add_evals(self, results: DataFrame, evaluator: str, at_ms: int, kind: str = "rubric") -> None:
        """Appends a verdict for each row (trace_id, score, passed, details or none), numbered in the order of writing."""
        if kind not in ("rubric", "llm_judge", "policy_check"):
            raise ValueError(f"unknown kind {kind!r}")
        details = F.col("details") if "details" in results.columns else F.lit("{}")

        def work(snap: Snapshot) -> dict:
            last = snap.table("evals").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            return {"evals": (results.select(
                "trace_id", F.lit(kind).alias("evaluator_type"), F.lit(evaluator).alias("evaluator_name"), "score", "passed", details.alias("details"),
                F.lit(at_ms).alias("evaluated_ms"), (F.monotonically_increasing_id() + last + 1).alias("seq"),
            ), None)}

        self.change(work)

    def delete(self, ids: DataFrame) -> None:
        """Takes traces (id) out with all that belongs to them; forks of them stay, without a parent."""
        gone = cut(ids.select("id").distinct())

        def work(snap: Snapshot) -> dict:
            touched = self.touched(gone)
            out = {n: (rows, touched) for n, rows in records.delete({n: snap.table(n, touched) for n in OWN}, gone).items()}
            lost = gone.select(F.col("id").alias("parent_trace_id"), F.lit(True).alias("__lost"))
            orphans = cut(snap.table("traces").select("id", "parent_trace_id").join(lost, "parent_trace_id", "left_semi").select("id"))
            more = sorted({*self.touched(orphans), *touched})  # forks lie in buckets of their own
            out["traces"] = (records.delete({"traces": snap.table("traces", more)}, gone)["traces"], more)
            aliases = snap.table("aliases").join(gone.withColumnRenamed("id", "trace_id"), "trace_id", "left_semi")
            named = self.touched(aliases.select("id"))
            out["aliases"] = (snap.table("aliases", named).join(gone.withColumnRenamed("id", "trace_id"), "trace_id", "left_anti"), named)
            return out

        self.change(work)

    def add_policy(self, name: str, action: str, pattern: dict, priority: int = 0) -> None:
        faults = judge.pattern_faults(pattern) + ([] if action in judge.ACTIONS else ["action: unknown"]) + ([] if name.strip() else ["name: is empty"])
        if not faults and not self.table("policies").where(F.col("name") == name).isEmpty():
            faults = ["name: is taken"]
        if faults:
            raise ValueError("; ".join(faults))
        self.append("policies", self.spark.createDataFrame([(name, action, priority, True, json.dumps(pattern))], SCHEMAS["policies"]))

    def change_policy(self, name: str, enabled: bool | None) -> None:
        """Switches a policy on or off; None removes it."""
        rows = self.table("policies")
        if rows.where(F.col("name") == name).isEmpty():
            raise ValueError(f"no policy {name!r}")
        mine = F.col("name") == name
        new = lambda df: df.where(~mine) if enabled is None else df.withColumn("enabled", F.when(mine, F.lit(enabled)).otherwise(F.col("enabled")))
        touched = self.touched(rows.where(mine).select("name"))
        self.change(lambda snap: {"policies": (new(snap.table("policies", touched)), touched)})

    def policies(self) -> list[judge.Policy]:
        """By priority, then name. Their number is a user's, not the data's."""
        out = []
        for r in self.table("policies").orderBy(F.col("priority").desc(), "name").collect():
            pattern = json.loads(r["pattern"])
            known = {k: v for k, v in pattern.items() if k in judge.CRITERIA}
            out.append(judge.Policy(r["name"], r["action"], r["priority"], enabled=r["enabled"], unknown_keys=len(known) < len(pattern), **known))
        return out
