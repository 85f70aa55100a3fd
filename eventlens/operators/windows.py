"""Event windows: absolute bounds, assignment of facts, calendar dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.config import Event
from eventlens.functions.times import ntz, plus_hours
from eventlens.operators.ordered import MAX_BROADCAST_ROWS

_TS = pa.timestamp("us")


def config_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, Sequence]]) -> DataFrame:
    """Configuration rows as a local relation (the optimizer knows their size).

    Naive timestamps travel as text, so they become TIMESTAMP_NTZ whatever the session prefers.
    """
    instants = [n for n, (t, _) in columns.items() if pa.types.is_timestamp(t)]
    data = {
        n: pa.array([None if x is None else str(x) for x in v], pa.string()) if n in instants else pa.array(v, t)
        for n, (t, v) in columns.items()
    }
    rows = spark.createDataFrame(pa.table(data))
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in instants})


def window_table(spark: SparkSession, events: Sequence[Event]) -> DataFrame:
    """One row per event and window with hour offsets and the event instant."""
    rows = [(e, w, i) for e in events for i, w in enumerate(e.windows, 1)]
    base = config_table(
        spark,
        {
            "event_version_key": (pa.string(), [e.event_key for e, _, _ in rows]),
            "occurred_at": (_TS, [e.occurred_at for e, _, _ in rows]),
            "window_type": (pa.string(), [w.window_type for _, w, _ in rows]),
            "relative_offset_start": (pa.int64(), [w.start_hours for _, w, _ in rows]),
            "relative_offset_end": (pa.int64(), [w.end_hours for _, w, _ in rows]),
        },
    )
    return absolute_bounds(base)


def absolute_bounds(windows: DataFrame) -> DataFrame:
    """Absolute start and end from the hour offsets, plus the sequence within the event."""
    by_start = Window.partitionBy("event_version_key").orderBy("relative_offset_start", "window_type")
    return (
        windows.withColumn("absolute_start_at", plus_hours(F.col("occurred_at"), F.col("relative_offset_start")))
        .withColumn("absolute_end_at", plus_hours(F.col("occurred_at"), F.col("relative_offset_end")))
        .withColumn("window_sequence", F.row_number().over(by_start))
    )


DAY_SALTS = 16


def join_on_day(facts: DataFrame, days: DataFrame, ts: str, day_rows: int) -> DataFrame:
    """Equi-join of facts and day-cut intervals (`_day`).

    Few day rows are broadcast. Many are copied `DAY_SALTS` times instead, and facts choose a
    copy by hash, so that a day holding most facts spreads over as many tasks.
    """
    facts = facts.withColumn("_day", F.to_date(ts))
    if day_rows <= MAX_BROADCAST_ROWS:
        return facts.join(F.broadcast(days), "_day").drop("_day")
    copies = days.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(DAY_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in facts.columns if c != "_day"]), F.lit(DAY_SALTS)).cast("int")
    return facts.withColumn("_salt", salt).join(copies, ["_day", "_salt"]).drop("_day", "_salt")


def assign_windows(
    facts: DataFrame,
    windows: DataFrame,
    ts: str = "published_at",
    closed_end: bool = False,
) -> DataFrame:
    """Range join of facts and windows as an equi-join on the day, then the exact bounds.

    Windows are cut into days, so the join hashes on the day instead of comparing every
    fact with every window. One small aggregate over the windows gives their number of days
    and their overall span: the span becomes a plain range filter the scan can push down, and
    their number decides how facts and days meet.
    """
    starts, ends = F.col("absolute_start_at"), F.col("absolute_end_at")
    span = windows.agg(
        F.min(starts).cast("string").alias("lo"),
        F.max(ends).cast("string").alias("hi"),
        F.sum(F.date_diff(ends, starts) + 2).alias("days"),
    ).first()
    w = windows.withColumn(
        "_day", F.explode(F.sequence(F.to_date(starts), F.to_date(ends), F.expr("interval 1 day")))
    )
    t = F.col(ts)
    inside = (t >= starts) & ((t <= ends) if closed_end else (t < ends))
    near = t.between(ntz(span["lo"]), ntz(span["hi"])) if span["lo"] else F.lit(False)
    return join_on_day(facts.filter(near), w, ts, span["days"] or 0).filter(inside)


def in_windows(facts: DataFrame, events: Sequence[Event], ts: str = "published_at") -> DataFrame:
    """Half-open assignment to configured windows; one row per fact and window hit.

    For the handful of windows of one run no join is needed: the windows are an array
    expression per row. The span of every event is a range filter the scan can push down.
    """
    t = F.col(ts)

    def at(event: Event, hours: int) -> Column:
        return ntz(str(event.occurred_at + timedelta(hours=hours)))

    near = F.lit(False)
    hits = []
    for e in events:
        lo, hi = min(w.start_hours for w in e.windows), max(w.end_hours for w in e.windows)
        near = near | ((t >= at(e, lo)) & (t < at(e, hi)))
        hits += [
            F.when(
                (t >= at(e, w.start_hours)) & (t < at(e, w.end_hours)),
                F.struct(F.lit(e.event_key).alias("event_version_key"), F.lit(w.window_type).alias("window_type")),
            )
            for w in e.windows
        ]
    hit = F.explode(F.array_compact(F.array(*hits)))
    return facts.filter(near).withColumn("_hit", hit).select("*", "_hit.*").drop("_hit")


def date_dimension(facts: DataFrame, ts: str) -> DataFrame:
    """One row per calendar day between the first and last instant of `facts`."""
    span = facts.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    days = span.filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_key")
    )
    return days.select(
        "date_key",
        F.dayofweek("date_key").cast("bigint").alias("day_of_week"),
        F.month("date_key").cast("bigint").alias("month"),
        F.year("date_key").cast("bigint").alias("year"),
    )


def time_dimension(facts: DataFrame, ts: str) -> DataFrame:
    """Seconds of the day that occur in `facts`, keyed HH:mm:ss."""
    return (
        facts.select(F.date_format(ts, "HH:mm:ss").alias("time_key"))
        .distinct()
        .select(
            "time_key",
            F.substring("time_key", 1, 2).cast("bigint").alias("hour"),
            F.substring("time_key", 4, 2).cast("bigint").alias("minute"),
            F.substring("time_key", 7, 2).cast("bigint").alias("second"),
        )
    )
