"""Replies of a language model that was asked to judge traces: the JSON in them, and the scores that it comes to. The model itself is injected."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.workers import ready

VERDICT = "trace_id string, preset string, score double, passed boolean, details string, error string"
# Presets with the score that passes, the marks of a quality review (0 to 10 each), and what a risk is worth.
PASSES = {"ai-root-cause": 0.5, "ai-quality-review": 0.7, "ai-security-audit": 0.8, "ai-optimization": 0.6}
MARKS = ("relevance", "completeness", "coherence", "accuracy")
RISKS = {"none": 1.0, "low": 0.8, "medium": 0.5, "high": 0.2, "critical": 0.0}
_FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)\n?```", re.S)
_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*+(?:\"|\Z|\\\Z)|[{}]", re.S)  # a string, an open one too, or a brace outside of strings


def _objects(text: str) -> list[str]:
    """Every balanced {...} of a text, in order."""
    out, depth, start = [], 0, 0
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            start = m.start() if not depth else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    return out


def _no_constant(name: str) -> float:
    raise ValueError(name)  # NaN and the infinities are no JSON


def answer(text: str) -> object:
    """The JSON that a reply comes to: the whole of it, else its last fenced block, else its last balanced object, that can be read. A model answers last,
    so what it quotes before is passed over. ValueError where there is none."""
    for part in (text, *(m[1] for m in reversed(list(_FENCED.finditer(text)))), *reversed(_objects(text))):
        try:
            return json.loads(part.strip(), parse_constant=_no_constant)
        except (ValueError, RecursionError):
            continue
    raise ValueError("no JSON in the reply")


def number(x: object) -> float:
    """A finite number, or a text that is wholly one; anything else is worth nothing, so that a field of a wrong kind never passes."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return 0.0
    try:
        n = float(x) if not isinstance(x, str) or "_" not in x else math.nan
    except (ValueError, OverflowError):
        return 0.0
    return n if math.isfinite(n) else 0.0


def score(preset: str, said: object) -> tuple[float, dict]:
    """(score from 0 to 1, details) of an answer to a preset."""
    data = said if isinstance(said, dict) else {}
    rounded = lambda x: math.floor(x * 1000 + 0.5) / 1000
    mark = lambda x: min(10.0, max(0.0, number(x)))
    if preset == "ai-quality-review":
        marks = {k: mark(data.get(k)) for k in MARKS}
        return rounded(sum(marks.values()) / (10 * len(MARKS))), marks
    if preset == "ai-optimization":
        own = mark(data.get("efficiency_score"))
        return rounded(own / 10), {"efficiency_score": own}
    if preset == "ai-root-cause":
        own = min(1.0, max(0.0, number(data.get("confidence"))))
        return rounded(own), {"confidence": own}
    declared = str(data.get("risk_level") if data.get("risk_level") is not None else "medium").lower()
    found = data.get("findings") if isinstance(data.get("findings"), list) else []
    named = [str(f.get("severity")).lower() for f in found if isinstance(f, dict)]
    worst = min((x for x in named if x in RISKS), key=RISKS.__getitem__, default=None)
    own = RISKS.get(declared, 0.5)
    least = min(own, RISKS[worst] if worst else 1.0)  # the worse of what it says in sum and what it lists
    return least, {"risk_level": declared if least == own else worst, "declared_risk_level": declared, "findings": len(found)}


def verdicts(replies: DataFrame) -> DataFrame:
    """VERDICT of each reply (trace_id, preset, reply). A reply without JSON, a null one and an unknown preset score 0 and fail, with an error."""
    ready()

    def one(preset: str | None, reply: str | None) -> tuple:
        if preset not in PASSES:
            return 0.0, False, None, f"unknown preset {preset}"
        try:
            s, details = score(preset, answer(reply or ""))
        except ValueError as e:
            return 0.0, False, None, str(e)
        return s, s >= PASSES[preset], json.dumps(details), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(p, r) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.float64(), pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], [c.split()[0] for c in VERDICT.split(", ")])

    return replies.selectExpr("cast(trace_id as string)", "cast(preset as string)", "cast(reply as string)").mapInArrow(run, VERDICT)


def judged(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """VERDICT of prompts (trace_id, preset, prompt), given who answers them: ask adds their reply."""
    return verdicts(ask(prompts))
