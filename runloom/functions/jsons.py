"""Payloads held as JSON text: defensive reading, canonical form, emptiness, text inside, and what a writer stores.

Small helpers by value run in Arrow-batched pandas UDFs, since Spark has no built-in for a canonical number, NFKC or a walk over any nesting.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import ready

_MISSING = object()


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str | None, fallback=_MISSING):
    """The value of a JSON text, of a repeated key the last; fallback (or else the text itself) where it is none."""
    if text is None:
        return None if fallback is _MISSING else fallback
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return text if fallback is _MISSING else fallback


def number_text(x: int | float) -> str:
    """A number as a double is written in JSON: the shortest digits, no exponent from 1e-6 up to 1e21."""
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return format(Decimal(repr(x)).to_integral_value(), "f") if x else "0"
    digits = repr(x)
    if "e" not in digits:
        return digits
    lead, power = digits.split("e")
    if -7 < int(power) < 0:
        sign, lead = ("-", lead[1:]) if lead[0] == "-" else ("", lead)
        return f"{sign}0.{'0' * (-int(power) - 1)}{lead.replace('.', '')}"
    return f"{lead}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def stable(value) -> str:
    """Canonical JSON: keys sorted at every level, no blanks, equal numbers written alike, at any depth."""
    out: list[str] = []
    todo: list = [(value,)]  # values in tuples, and texts that stand between them
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (x,) = x
        if isinstance(x, bool) or x is None or isinstance(x, str):
            out.append(json.dumps(x, ensure_ascii=False))
        elif isinstance(x, (int, float)):
            out.append(number_text(x))
        else:
            parts: list = []
            for k in x if isinstance(x, list) else sorted(x):
                parts += [","] * bool(parts)
                parts += [(k,)] if isinstance(x, list) else [json.dumps(k, ensure_ascii=False) + ":", (x[k],)]
            todo += ["]" if isinstance(x, list) else "}", *reversed(parts), "[" if isinstance(x, list) else "{"]
    return "".join(out)


def canonical_text(text: str | None) -> str | None:
    return None if text is None else stable(parse(text))


def strings_in(value) -> Iterator[str]:
    """Every string value at any depth; keys are none."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def searchable_text(text: str | None) -> str:
    """JSON text and every string in it, one a line, so that escapes hide nothing from a search."""
    return "" if text is None else "\n".join([text, *strings_in(parse(text))])


_UNSEEN = re.compile("[\u200b-\u200d\ufeff\u00ad]")


def fold_text(text: str | None) -> str | None:
    """NFKC, without zero-width characters and soft hyphens, in lower case."""
    return None if text is None else _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower()


def stored_text(text: str | None) -> str | None:
    """What a writer puts into a JSON column: a text that is a JSON object or array as it is, any other as a JSON string."""
    if text is None:
        return None
    return text if isinstance(parse(text, None), (dict, list)) else json.dumps(text, ensure_ascii=False)


def answers(text: str | None) -> bool:
    """Whether a payload says something: not null, blank, empty or a container of such."""
    todo = [parse(text)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif isinstance(x, dict):
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
        elif x is not None:
            return True
    return False


def escape_text(text: str | None, strict: bool = False) -> str | None:
    r"""Control characters as \xNN; strict takes tab and line breaks too."""
    if text is None:
        return None
    keep = "" if strict else "\t\n\r"
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: m[0] if m[0] in keep else f"\\x{ord(m[0]):02x}", text)


def _mapped(f: Callable, kind: T.DataType, *more) -> Callable[[Column], Column]:
    def column(c: Column) -> Column:
        ready()

        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda v: f(None if v is None or v is pd.NA else v, *more), na_action=None)

        return F.pandas_udf(run, kind)(c)

    return column


canonical = _mapped(canonical_text, T.StringType())
searchable = _mapped(searchable_text, T.StringType())
fold = _mapped(fold_text, T.StringType())
stored = _mapped(stored_text, T.StringType())
is_answer = _mapped(answers, T.BooleanType())
escaped = _mapped(escape_text, T.StringType())
escaped_strictly = _mapped(escape_text, T.StringType(), True)


def input_key(canon: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a canonical object; null for an empty one, which matches nothing."""
    return F.when(~canon.isin("{}", "null", "[]"), F.substring(F.sha2(canon, 256), 1, 16))


def value_at(c: Column, path: str) -> Column:
    """The scalar or JSON text at a path; null where there is none or the text is no JSON."""
    return F.get_json_object(c, path)


def or_null_text(c: Column) -> Column:
    """A text column of a JSON scalar: strings as they are, numbers and booleans as text, objects and arrays null."""
    value = F.try_parse_json(c)
    kind = F.schema_of_variant(value)
    return F.when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.try_variant_get(value, "$", "string"))


def or_null_number(c: Column) -> Column:
    """A finite number, or the text of one, else null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def earlier_ref(ref: Column, own: Column) -> Column:
    """A whole number of 1 or more that is below its own step's, else null."""
    n = ref.try_cast("double")
    return F.when((n == F.floor(n)) & (n >= 1) & (n < own), n.cast("int"))


def merged(first: Column, second: Column) -> Column:
    """Two JSON objects as one map<string, variant>; the keys of the second win."""
    kind = "map<string, variant>"
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    entries = lambda c: F.map_entries(F.coalesce(F.from_json(c, kind), empty))
    keep = F.filter(entries(first), lambda x: ~F.coalesce(F.array_contains(F.map_keys(F.coalesce(F.from_json(second, kind), empty)), x["key"]), F.lit(False)))
    return F.map_from_entries(F.concat(keep, entries(second)))
