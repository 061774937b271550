"""Points in time and spans of time as users write them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a duration in milliseconds.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    """Milliseconds of a duration as 30s, 5m, 2h, 7d or 1w; ValueError for anything else."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w)\s*", text.lower())
    if not m:
        raise ValueError(f"{text!r} is no duration")
    return int(float(m[1]) * UNITS[m[2]])


def since_ms(text: str, now: datetime | None = None) -> int:
    """Milliseconds since 1970 of a bound: a duration back from now, or an ISO date and time; one without a zone is in local time."""
    now = now or datetime.now(timezone.utc)
    try:
        return int((now - timedelta(milliseconds=duration_ms(text))).timestamp() * 1000)
    except ValueError:
        pass
    try:
        at = datetime.fromisoformat(re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", text.strip()))
    except ValueError:
        raise ValueError(f"{text!r} is neither a duration nor a date") from None
    return int((at if at.tzinfo else at.astimezone()).timestamp() * 1000)


def instant_ms(text: Column) -> Column:
    """Milliseconds since 1970 of a timestamp in any of the usual spellings; one without a zone is in UTC whatever the session's zone is."""
    zoned = text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)\s*$")
    return F.unix_millis(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def nanos_ms(nanos: Column) -> Column:
    """Milliseconds of a count of nanoseconds held as text; null for none, and outside the years 1000 to 9999."""
    ms = F.floor(nanos.try_cast("decimal(20,0)") / 1_000_000).cast("bigint")
    return F.when((ms != 0) & ms.between(-30610224000000, 253402300799999), ms)


def duration_text(ms: Column) -> Column:
    """A duration for display: 12ms, 3.4s or 5m 6s; a dash for none."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), "-").when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", (ms / 1000).cast("double")), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )
