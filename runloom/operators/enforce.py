"""What a verdict or a finished process means to those who wait for it: exits, responses in each harness's dialect, and supervised runs."""

from __future__ import annotations

import signal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import variants as V

# The exit code by which a hook blocks, and the dialects whose hooks read a decision.
BLOCKED = 2
ASKING, DECIDING = ("claude-code", "codex"), ("gemini",)


def exits(verdicts: DataFrame, interactive: bool = False) -> DataFrame:
    """verdicts (verdict, confirmed or none) with what they come to (final) and the exit code. A review that nobody can be asked for, or that is not confirmed, is a denial; no
    verdict allows."""
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False)) if "confirmed" in verdicts.columns else F.lit(False)
    v = F.col("verdict")
    final = F.when(v == "deny", "deny").when(v == "require_review", F.when(F.lit(interactive) & confirmed, "allow").otherwise("deny")).when(v == "warn", "warn").otherwise("allow")
    return verdicts.withColumn("final", final).withColumn("exit_code", F.when(final == "deny", BLOCKED).otherwise(0))


def responses(verdicts: DataFrame) -> DataFrame:
    """verdicts (dialect, event_name, verdict, policy, reason) with the answer to the harness: stdout (JSON or null), stderr, exit_code.

    A warning never blocks. Dialects that take a decision get it as JSON with exit 0, as ask, or as a denial that names the review, for a review; all others are
    blocked by the exit code, with the reason on stderr. What is allowed says nothing.
    """
    v, dialect = F.col("verdict"), F.col("dialect")
    reason = F.coalesce("reason", F.trim(F.concat(F.lit("blocked by policy "), F.coalesce("policy", F.lit("")))))
    blocks = F.coalesce(v.isin("deny", "require_review"), F.lit(False))
    asked = F.to_json(F.struct(F.struct(
        F.col("event_name").alias("hookEventName"), F.when(v == "require_review", "ask").otherwise("deny").alias("permissionDecision"), reason.alias("permissionDecisionReason")
    ).alias("hookSpecificOutput")))
    refused = F.to_json(F.struct(F.lit("deny").alias("decision"), F.when(v == "require_review", F.concat(F.lit("review required: "), reason)).otherwise(reason).alias("reason")))
    told = F.to_json(F.struct(F.concat(F.lit("runloom: "), reason).alias("systemMessage")))
    some = F.coalesce(dialect, F.lit(""))
    plain = blocks & ~some.isin(*ASKING, *DECIDING)
    out = F.when(blocks & some.isin(*ASKING), asked).when(blocks & some.isin(*DECIDING), refused).when((v == "warn") & some.isin(*ASKING), told)
    return verdicts.withColumns({"stdout": out, "stderr": F.when(plain, reason), "exit_code": F.when(plain, BLOCKED).otherwise(0)})


def exit_code(code: Column, killed: Column) -> Column:
    """A process's exit code: 128 and the signal's number for one that was killed by a signal (by name), 0 where nothing is known."""
    numbers = F.create_map(*(F.lit(x) for s in signal.Signals for x in (s.name, s.value)))
    return F.coalesce(128 + F.try_element_at(numbers, killed), code, F.lit(0)).cast("int")


def finalised(traces: DataFrame, runs: DataFrame) -> DataFrame:
    """traces as the end of the processes that ran them leaves them. runs: (id, started_ms, ended_ms, code, killed, declared, repaired), of ended processes.

    A status that the child declared stays, and only the time it left out is filled in. Else a trace that still runs, whose status was a repair of one that couldn't be read,
    or whose process failed takes its status, end, time and error from the process. The exit code is put in the metadata in any case. Traces without
    a process are as before.
    """
    own = ("started_ms", "ended_ms", "code", "killed", "declared", "repaired")
    ended = runs.select(F.col("id"), *(F.col(c).alias(f"__{c}") for c in own), F.lit(True).alias("__ran"))
    rows = traces.join(ended, "id", "left").withColumn("__exit", exit_code(F.col("__code"), F.col("__killed")))
    ran, yes = F.col("__ran").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(False))
    took = F.col("__ended_ms") - F.col("__started_ms")
    failed = F.col("__exit") != 0
    takes = ran & ~yes("__declared") & ((F.col("status") == "running") | failed | yes("__repaired"))
    why = F.when(F.col("__killed").isNotNull(), F.format_string("child killed by signal %s (exit %d)", "__killed", "__exit")).otherwise(F.format_string("child exited with code %d", "__exit"))
    at = F.date_format(F.timestamp_millis("__ended_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.when(V.is_object(V.parsed(F.col("metadata"))), F.col("metadata")).otherwise("{}")
    new = {
        "status": F.when(takes, F.when(failed, "failed").otherwise("completed")).otherwise(F.col("status")),
        "ended_at": F.when(takes, at).otherwise(F.col("ended_at")),
        "total_duration_ms": F.when(takes | (ran & yes("__declared") & F.col("total_duration_ms").isNull()), took).otherwise(F.col("total_duration_ms")),
        "error": F.when(takes & failed, why).otherwise(F.col("error")),
        "metadata": F.when(ran, F.to_json(jsons.merged(meta, F.to_json(F.struct(F.col("__exit").alias("exit_code")))))).otherwise(F.col("metadata")),
    }
    return rows.select(*(new[c].alias(c) if c in new else c for c in traces.columns))
