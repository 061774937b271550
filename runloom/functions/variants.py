"""Reading values of open JSON held as VARIANT; what is absent or of another kind is null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value of a JSON text, null where it is none."""
    return F.try_parse_json(text)


def kind(v: Column, path: str = "$") -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>; null where nothing is."""
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def fields(v: Column, names: Iterable[str]) -> Column:
    """A struct of these fields of an object, each a value of its own, taken out at once; null where there is no object."""
    return F.try_variant_get(v, "$", _struct(names))


def listed(v: Column, path: str, names: Iterable[str]) -> Column:
    """What fields() gives of each element of an array, null for one that is no object; null where there is no array."""
    return F.try_variant_get(v, path, f"array<{_struct(names)}>")


def _struct(names: Iterable[str]) -> str:
    return f"struct<{', '.join(f'{n}: variant' for n in names)}>"


def has(v: Column, path: str) -> Column:
    """Whether something other than null is there."""
    if path == "$":
        return v.isNotNull() & ~F.is_variant_null(v)  # without a look at all that an object holds
    return F.coalesce(kind(v, path) != "VOID", F.lit(False))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(False))


def is_text(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def is_number(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.substring(kind(v, path), 1, 3).isin("BIG", "DOU", "FLO", "DEC"), F.lit(False))


def text(v: Column, path: str = "$") -> Column:
    return F.when(is_text(v, path), F.try_variant_get(v, path, "string"))


def number(v: Column, path: str = "$") -> Column:
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))


def whole(v: Column, path: str = "$") -> Column:
    n = number(v, path)
    return F.when(n == F.floor(n), n)


def scalar_text(v: Column, path: str = "$") -> Column:
    """A string as it is; a number or boolean as text."""
    k = kind(v, path)
    return F.when(~(k.startswith("OBJECT") | k.startswith("ARRAY")), F.try_variant_get(v, path, "string"))


def items(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def json(v: Column, path: str = "$") -> Column:
    """The JSON text of what is there; null for nothing and null."""
    return F.when(has(v, path), F.to_json(F.try_variant_get(v, path, "variant")))


def payload(v: Column, path: str = "$") -> Column:
    """A payload as stored: an object or array as JSON, a string that holds one as it is, any other value as JSON."""
    inner = text(v, path)
    nested = F.try_parse_json(inner)
    return F.when(is_object(nested) | is_array(nested), inner).otherwise(json(v, path))
