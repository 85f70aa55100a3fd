"""Durations, instants and offsets. Timestamps at rest are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def duration_seconds(text: Column) -> Column:
    """ISO-8601 days/hours/minutes/seconds to seconds; empty, NULL or invalid gives 0."""

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, _DURATION, group).try_cast("bigint"), F.lit(0))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.coalesce(total, F.lit(0)).cast("bigint")


def utc_ntz(text: Column) -> Column:
    """Text instant to naive UTC, microseconds kept. Text without an offset already is UTC."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    micros = F.unix_micros(zoned.try_cast("timestamp"))
    return from_micros(micros)


def from_micros(micros: Column) -> Column:
    """Microseconds since the epoch to TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds from `start` to `end`, fraction kept (whole-second units truncate)."""
    return micros_between(start, end) / F.lit(1_000_000.0)


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
