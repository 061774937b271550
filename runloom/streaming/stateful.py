"""Keyed streams with RocksDB state: capture events folded live, trace by trace, and span batches that come late, twice or out of order.

The state of a trace is what its rows may still depend on, so input is read once and state grows with the traces that are open (and with the
closed ones that are still kept for late results). Both processors give the same rows whatever the order and the cut of the
micro-batches: every field is a register that the highest sequence number wins, and what opens a step stays until it is known to be the first.

Output is an append-only log of changed rows (kind, trace_id, step_number, version, gone, body): ``current`` keeps the last version of each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import variants as V
from ..functions.workers import ready
from ..operators.validate import REFS, reference

CHANGES = "kind string, trace_id string, step_number int, version bigint, gone boolean, body string"
STEP = "step_type string, name string, input string, output string, error string, model string, tokens_used bigint, duration_ms bigint, parent_step_number int, caused_by_step_number int"
DECISION = "options string, chosen string, rationale string, confidence double, decided_by string"
TRACE = "agent_name string, input string, status string, output string, error string, total_tokens bigint, total_cost_usd double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPENS = ("step_start", "step")


def keyed(spark: SparkSession) -> SparkSession:
    """The session, its state kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ready()
    return spark


def patches(events: DataFrame) -> DataFrame:
    """(trace_id, seq, type, step_number, patch) of usable validate.read_events() rows, patch being JSON of the fields that the event gives, null ones too.
    Other columns of events, such as the time of arrival, stay."""
    v, kind_ = V.parsed(F.col("event")), F.col("type")
    of = lambda *types: kind_.isin(*types)
    usable = lambda c: ~F.array_contains("out", c)
    given = lambda c: F.try_variant_get(v, f"$.{c}", "variant").isNotNull() & usable(c)
    there = lambda c: V.has(v, f"$.{c}") & usable(c)
    said = F.coalesce(V.text(v, "$.error"), V.json(v, "$.error"))
    d = F.when(of("decision"), v).otherwise(F.try_variant_get(v, "$.decision", "variant"))
    decision = F.to_json(F.struct(
        F.coalesce(V.json(d, "$.options"), F.lit("[]")).alias("options"), V.text(d, "$.chosen").alias("chosen"), V.text(d, "$.rationale").alias("rationale"),
        V.number(d, "$.confidence").alias("confidence"), F.coalesce(V.text(d, "$.decided_by"), F.lit("agent")).alias("decided_by"),
    ))
    whole = lambda c: V.number(v, f"$.{c}").cast("bigint")
    opens, ends, any_ = of(*_OPENS), of("step", "step_end"), of("step_start", "step", "step_end")
    fields: list[tuple[str, Column, Column]] = [
        ("step_type", opens & given("step_type"), V.text(v, "$.step_type")), ("name", opens & given("name"), V.text(v, "$.name")), ("input", opens & given("input"), V.payload(v, "$.input")),
        ("output", ends & given("output"), V.payload(v, "$.output")), ("error", ends & given("error"), said), ("model", any_ & given("model"), V.text(v, "$.model")),
        ("tokens_used", ends & given("tokens_used"), whole("tokens_used")), ("duration_ms", ends & given("duration_ms"), whole("duration_ms")),
        *((f"{r}_number", opens & reference(v, r)[0] & usable(r) & usable(f"{r}_number"), reference(v, r)[1].cast("int")) for r in REFS),
        ("decision", of("decision") | (of("step") & V.has(v, "$.decision")), decision),
        ("agent_name", of("trace_start") & there("agent_name"), V.text(v, "$.agent_name")), ("input", of("trace_start") & there("input"), V.payload(v, "$.input")),
        ("status", of("trace_end"), F.col("status")), ("output", of("trace_end") & there("output"), V.payload(v, "$.output")), ("error", of("trace_end") & there("error"), said),
        ("total_tokens", of("trace_end") & there("total_tokens"), whole("total_tokens")), ("total_cost_usd", of("trace_end") & there("total_cost_usd"), V.number(v, "$.total_cost_usd")),
    ]
    entries = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))) for name, when, value in fields)))
    patch = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    more = [c for c in events.columns if c not in ("event", "type", "trace_id", "seq", "step_number", "status", "warning", "repaired", "out")]
    return events.where("event is not null and trace_id is not null").select("trace_id", "seq", "type", "step_number", patch.alias("patch"), *more)


def _later(register: dict, seq: int, fields: dict) -> None:
    """Each field takes the value of the highest sequence number that gives it."""
    for name, value in fields.items():
        if name not in register or register[name][0] < seq:
            register[name] = [seq, value]


def apply_step(step: dict, seq: int, kind: str, fields: dict) -> None:
    """Takes an event into a step: what opens it is kept, what changes it goes to the registers."""
    if kind in _OPENS:
        step["opens"][str(seq)] = [kind, fields]
    else:
        _later(step["last"], seq, fields)


def step_row(step: dict, began: int | None, bound: int | None) -> dict | None:
    """The step as a trace shows it that began and ended at these numbers: opened by the first that does so in between, then changed by later ones."""
    first = min((s for s in map(int, step["opens"]) if began is not None and began <= s and (bound is None or s < bound)), default=None)
    if first is None:
        return None
    out = dict(step["opens"][str(first)][1])
    out.update({name: value for name, (seq, value) in step["last"].items() if seq > first})
    out["input"] = out.get("input") or "{}"
    return out


def trace_row(head: dict) -> dict | None:
    """The trace's own fields; one that is not ended is running, or a timeout once it was closed."""
    if head["began"] is None:
        return None
    out = {name: value for name, (_, value) in head["start"].items()}
    out.update({name: value for name, (seq, value) in head["end"].items() if seq > head["began"]})
    out.setdefault("status", "running" if head["closed"] is None else "timeout")
    return out


def bound(head: dict) -> int | None:
    """From this number on no step opens: the trace has ended, or was closed behind all that had come."""
    return min((x for x in (head["ended"], head["closed"]) if x is not None), default=None)


def over(head: dict) -> bool:
    """Whether the trace has begun and was ended, or closed, since."""
    return head["began"] is not None and (head["closed"] is not None or head["end"].get("status", [-1])[0] > head["began"])


class TraceFold(StatefulProcessor):
    """Folds patches() of a trace: a value state for the trace, a map state with an entry a step.

    A trace that is silent for silence_ms is closed as a timeout, unless leave_open; steps no longer open in it, but later step_end, decision
    and trace_end events still count, as they do in one that ended. A closed trace is kept for retain_ms (forever if None) and then forgotten, and so is one
    whose start has not come within silence_ms. clock: ``processing``, or ``arrival`` for the time stamps in the column arrived,
    which must rise from batch to batch (as current_timestamp() does), so that none is late: then what closes a trace is told from the data alone.
    """

    def __init__(self, silence_ms: int, retain_ms: int | None = None, leave_open: bool = False, clock: str = "processing"):
        self.silence_ms, self.retain_ms, self.leave_open, self.clock = silence_ms, retain_ms, leave_open, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "body string")
        self.steps = handle.getMapState("steps", "step_number int", "body string")

    def _head(self) -> dict:
        if self.head.exists():
            return json.loads(self.head.get()[0])
        return {"began": None, "ended": None, "closed": None, "top": 0, "start": {}, "end": {}, "version": 0, "due": None}

    def _wake(self, head: dict, now: int) -> None:
        """Sets the one timer of a trace: for its silence while it runs, then for its end."""
        wait = self.retain_ms if over(head) else None if self.leave_open and head["began"] is not None else self.silence_ms
        if head["due"] is not None:
            self.handle.deleteTimer(head["due"])
        head["due"] = None if wait is None else now + wait
        if wait is not None:
            self.handle.registerTimer(head["due"])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        head, touched, old = self._head(), {}, {}
        before, was = (head["began"], bound(head)), trace_row(head)
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock == "processing" else 0
        for r in rows:
            if self.clock == "arrival":
                now = max(now, int(r["arrived"].timestamp() * 1000))
            if r["type"] == "tick":
                continue
            fields, seq = json.loads(r["patch"]), r["seq"]
            head["top"] = max(head["top"], seq)
            if r["type"] == "trace_start":
                head["began"] = min(seq, head["began"]) if head["began"] is not None else seq
                _later(head["start"], seq, fields)
            elif r["type"] == "trace_end":
                head["ended"] = min(seq, head["ended"]) if head["ended"] is not None else seq
                _later(head["end"], seq, fields)
            elif r["step_number"] is not None:
                n = r["step_number"]
                if n not in touched:
                    touched[n] = json.loads(self.steps.getValue((n,))[0]) if self.steps.containsKey((n,)) else {"opens": {}, "last": {}}
                    old[n] = step_row(touched[n], *before)
                apply_step(touched[n], seq, r["type"], fields)
        after = (head["began"], bound(head))
        changed = [(n, old[n], step_row(step, *after)) for n, step in touched.items()]
        if before != after:  # steps that no event touched may open or go
            rest = ((k[0], json.loads(v[0])) for k, v in self.steps.iterator() if k[0] not in touched)
            changed += [(n, step_row(step, *before), step_row(step, *after)) for n, step in rest]
        for n, step in touched.items():
            self.steps.updateValue((n,), (json.dumps(step),))
        head["version"] += 1
        yield from self._rows(key[0], head, was, changed)
        self._wake(head, now)
        self.head.update((json.dumps(head),))

    def _rows(self, trace_id: str, head: dict, was: dict | None, changed: list) -> Iterator[Row]:
        row = lambda kind, n, new: Row(kind=kind, trace_id=trace_id, step_number=n, version=head["version"], gone=new is None, body=json.dumps(new))
        if (now := trace_row(head)) != was:
            yield row("trace", None, now)
        for n, a, b in changed:
            decided = lambda x: (x or {}).get("decision")
            if decided(a) != decided(b):
                yield row("decision", n, json.loads(decided(b)) if decided(b) else None)
            if a != b:
                yield row("step", n, b)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        head, at = self._head(), expiredTimerInfo.getExpiryTimeInMs()
        if head["due"] != at:
            return
        if head["began"] is None or over(head):  # never begun, or closed and kept for long enough
            self.head.clear()
            self.steps.clear()
            return
        was = trace_row(head)
        head["closed"], head["due"], head["version"] = head["top"] + 1, None, head["version"] + 1
        yield from self._rows(key[0], head, was, [])
        self._wake(head, at)
        self.head.update((json.dumps(head),))

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, silence_ms: int, retain_ms: int | None = None, leave_open: bool = False, clock: str = "processing") -> DataFrame:
    """CHANGES of a stream of patches()."""
    keyed(rows.sparkSession)
    if clock == "arrival":
        rows = rows.withWatermark("arrived", "0 seconds")
    mode = {"arrival": "EventTime", "processing": "ProcessingTime"}[clock]
    return rows.groupBy("trace_id").transformWithState(TraceFold(silence_ms, retain_ms, leave_open, clock), CHANGES, "Append", mode)


SPAN = (
    "trace_id string, span_id string, parent_id string, place string, start_ms bigint, end_ms bigint, step_type string, step_name string, input string, output string,"
    " tokens bigint, model string, error string, metadata string"
)
KEPT = [c.split()[0] for c in SPAN.split(", ")][2:]
BUCKETS = 1 << 16  # of traces; a batch reads the spans of the buckets that it touches
SPAN_STEP = "step_type string, name string, input string, output string, duration_ms bigint, tokens_used bigint, model string, error string, metadata string, parent_step_number int"


def numbered(spans: dict[str, dict]) -> dict[int, dict]:
    """Steps by number of the distinct spans of a trace (by span id), as otlp.span_steps numbers them: by start, the first root left out."""
    order = sorted(spans.items(), key=lambda x: (x[1]["start_ms"] is None, x[1]["start_ms"] or 0, x[1]["place"]))
    root = next((i for i, (_, s) in enumerate(order) if s["step_type"] == "root"), None)
    order = [x for i, x in enumerate(order) if i != root]
    number, out = {span_id: n for n, (span_id, _) in enumerate(order, 1)}, {}
    for n, (_, s) in enumerate(order, 1):
        up = number.get(s["parent_id"])
        timed = None not in (s["start_ms"], s["end_ms"]) and s["end_ms"] >= s["start_ms"]
        out[n] = {
            "step_type": "thought" if s["step_type"] == "root" else s["step_type"], "name": s["step_name"], "input": s["input"] or "{}", "output": s["output"],
            "duration_ms": s["end_ms"] - s["start_ms"] if timed else None, "tokens_used": s["tokens"] or None, "model": s["model"], "error": s["error"],
            "metadata": s["metadata"], "parent_step_number": up if up is not None and up < n else None,
        }
    return out


def _take(spans: dict[str, dict], span_id: str, span: dict) -> bool:
    """Whether the span is taken: of those with an id the earliest place wins."""
    have = spans.get(span_id)
    if first := have is None or span["place"] < have["place"]:
        spans[span_id] = span
    return first


class SpanSteps(StatefulProcessor):
    """Steps of the spans of traces, dealt in BUCKETS by a hash of the trace: a map state with an entry for each version, the spans that came with it. What was given out last
    follows from them. The traces of a bucket share its calls of the state, which cost far more than the work on a short trace.

    A span that comes again is dropped (the earlier place wins, so that the order of the batches doesn't matter); one that comes late is put in its place and
    what it renumbers is given out anew; a child waits with its parent's id and is linked when the parent comes. No watermark drops anything.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "version bigint", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came: dict[str, list[Row]] = {}
        for r in rows:
            came.setdefault(r["trace_id"], []).append(r)
        traces: dict[str, dict] = {t: {} for t in came}
        fresh, version = {}, 1
        for _, v in self.spans.iterator():
            version += 1
            for trace_id, own in json.loads(v[0]).items():
                if trace_id in traces:
                    for span_id, span in own.items():
                        _take(traces[trace_id], span_id, span)
        for trace_id, own in came.items():
            spans, new = traces.pop(trace_id), {}
            shown = numbered(spans)
            for r in own:
                span = {k: r[k] for k in KEPT}
                if _take(spans, r["span_id"], span):
                    new[r["span_id"]] = span
            if not new:
                continue
            fresh[trace_id] = new
            now = numbered(spans)
            for n, step in now.items():
                if shown.get(n) != step:
                    yield Row(kind="step", trace_id=trace_id, step_number=n, version=version, gone=False, body=json.dumps(step))
            for n in shown.keys() - now.keys():  # a root that came late takes the number of none
                yield Row(kind="step", trace_id=trace_id, step_number=n, version=version, gone=True, body="null")
        if fresh:
            self.spans.updateValue((version,), (json.dumps(fresh),))

    def close(self) -> None:
        pass


def span_stream(spans: DataFrame) -> DataFrame:
    """CHANGES of a stream of otlp.read_spans(). The place of delivery is compared as text of fixed width."""
    keyed(spans.sparkSession)
    place = F.concat_ws(".", *(F.lpad(F.col(f"seq.{c}").cast("string"), 20, "0") for c in ("seq", "i", "j", "k")))
    rows = spans.withColumn("place", place).select(F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).alias("bucket"), "trace_id", "span_id", *KEPT)
    return rows.groupBy("bucket").transformWithState(SpanSteps(), CHANGES, "Append", "None")


LINE = "trace_id string, step_number int, phase string, step_type string, name string, error string"


class Watch(StatefulProcessor):
    """Lines for someone who watches a run: one when a step begins and one when it is done, each once, however often the step is given out anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "step string", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["version"], r["step_number"] or 0)):
            step = json.loads(r["body"])
            if r["kind"] != "step" or r["gone"]:
                continue
            done = step.get("output") is not None or step.get("error") is not None
            for phase in ["begun", "done"][: 1 + done]:
                if not self.seen.containsKey((f"{r['step_number']} {phase}",)):
                    self.seen.updateValue((f"{r['step_number']} {phase}",), (r["version"],))
                    yield Row(trace_id=key[0], step_number=r["step_number"], phase=phase, step_type=step.get("step_type"), name=step.get("name"), error=step.get("error"))

    def close(self) -> None:
        pass


def watch_stream(changes: DataFrame) -> DataFrame:
    """LINE of a stream of CHANGES, as read from where they were written. A last run over all that is there drains it before the end."""
    keyed(changes.sparkSession)
    return changes.groupBy("trace_id").transformWithState(Watch(), LINE, "Append", "None")


def start(changes: DataFrame, out: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Appends the changes to Parquet files in out, each once; by default until all that is there is read."""
    stream = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, out: str, kind: str, schema: str) -> DataFrame:
    """The present rows of a kind: trace_id, step_number and the fields of schema."""
    rows = spark.read.schema(CHANGES).parquet(out).where(F.col("kind") == kind)
    last = rows.groupBy("trace_id", "step_number").agg(F.max_by(F.struct("gone", "body"), "version").alias("x"))
    fields = [f.split() for f in schema.split(", ")]
    body = F.from_json("x.body", ", ".join(f"{name} string" for name, _ in fields))  # numbers come as text or as numbers
    live = last.where("not x.gone").select("trace_id", "step_number", body.alias("b"))
    return live.select("trace_id", "step_number", *(F.col(f"b.{name}").cast(kind_).alias(name) for name, kind_ in fields))
