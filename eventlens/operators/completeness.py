"""Incremental scans: continuity, watermarks, gaps, unit completeness, run telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import CAPPED_SCANS
from eventlens.functions.keys import sha256
from eventlens.functions.times import micros_between, seconds_between
from eventlens.operators.history import UNIT_KEYS
from eventlens.operators.ordered import lookup, neighbours, running_before
from eventlens.session import stored


def scan_order(items: DataFrame) -> DataFrame:
    """One comparable position per scanned item from page and position in the page."""
    return items.withColumn("_pos", F.struct("page_number", "item_position"))


def ingestible(items: DataFrame, checkpoints: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items before the first one older than the scope's watermark, and where each scan crossed it.

    Items at or behind the crossing are not ingested. A scope without checkpoint never crosses.
    """
    marks = checkpoints.select("scope", F.col("committed_watermark_at").alias("_w"))
    located = lookup(scan_order(items), marks, ["scope"], "left", hot)
    crossing = located.groupBy("scope").agg(
        F.min(F.when(F.col("published_at") < F.col("_w"), F.col("_pos"))).alias("_cross")
    )
    # one row per scope, written once: all that follows would find it anew, and sort for it in one task
    crossing = stored(crossing)
    placed = lookup(located, crossing, ["scope"], "inner", hot)
    return placed.filter(F.col("_cross").isNull() | (F.col("_pos") < F.col("_cross"))), crossing


def continuity(
    items: DataFrame, scans: DataFrame, checkpoints: DataFrame, boundary: DataFrame, hot: int | None = None
) -> DataFrame:
    """Continuity state per scope as set operations on the scanned items.

    `items`: scope, page_number, item_position, source_comment_id, published_at (scan order).
    `scans`: scope, more_pages. `checkpoints`: scope, committed_watermark_at.
    `boundary`: scope, source_comment_id, the ids at the committed watermark.

    Boundary ids seen before the crossing are matched by an anti join instead of collecting
    id sets, so neither a busy scope nor a crowded watermark second has to fit into one row. What is known of a
    scope is brought together by one aggregation; a chain of joins would keep two sorted sides each in one task.
    """
    marks = checkpoints.select("scope", F.col("committed_watermark_at").alias("_w"))
    before, crossing = ingestible(items, checkpoints, hot)
    seen = before.filter(F.col("published_at") == F.col("_w")).select("scope", "source_comment_id").distinct()
    remaining = (
        boundary.select("scope", "source_comment_id")
        .distinct()
        .join(seen, ["scope", "source_comment_id"], "left_anti")
        .groupBy("scope")
        .agg(F.count(F.lit(1)).alias("remaining_boundary_ids"))
    )
    ingested = before.groupBy("scope").agg(
        F.count(F.lit(1)).alias("records_observed"), F.max("published_at").alias("candidate_watermark_at")
    )
    crossed, rest = F.col("_crossed"), F.col("remaining_boundary_ids")
    state = (
        F.when(crossed & (rest == 0), F.lit("COMPLETE_TO_WATERMARK"))
        .when(~F.col("more_pages") & crossed & (rest > 0), F.lit("POTENTIAL_GAP"))
        .when(~F.col("more_pages"), F.lit("COMPLETE_TO_WATERMARK"))
        .when(~F.col("_had_checkpoint"), F.lit("INITIAL_LOAD_CAPPED"))
        .otherwise(F.lit("CAPPED_BEFORE_WATERMARK"))
    )
    parts = [
        crossing.select("scope", F.col("_cross").isNotNull().alias("_crossed")),
        ingested,
        remaining,
        marks.withColumn("_had_checkpoint", F.lit(True)),
    ]
    known = scans.select("scope", "more_pages", F.lit(True).alias("_scanned"))
    for part in parts:  # a scope without name has nothing but its scan
        known = known.unionByName(part.filter("scope IS NOT NULL"), allowMissingColumns=True)
    return (
        known.groupBy("scope")
        .agg(*[F.max(c).alias(c) for c in known.columns if c != "scope"])
        .filter("_scanned")
        .fillna(0, ["remaining_boundary_ids", "records_observed"])
        .fillna(False, ["_had_checkpoint", "_crossed"])
        .withColumn("continuity_status", state)
        .select(
            "scope",
            "continuity_status",
            F.when(F.col("_w").isNotNull(), crossed & (rest == 0)).alias("watermark_reached"),
            "remaining_boundary_ids",
            "records_observed",
            F.col("_w").alias("committed_watermark_at"),
            "candidate_watermark_at",
        )
    )


def advance_watermark(states: DataFrame) -> DataFrame:
    """Next committed watermark: moves only after a complete scan that observed something."""
    moves = (
        (F.col("continuity_status") == "COMPLETE_TO_WATERMARK")
        & F.col("candidate_watermark_at").isNotNull()
    )
    return states.withColumn("watermark_advanced", moves).withColumn(
        "next_watermark_at",
        F.when(moves, F.col("candidate_watermark_at")).otherwise(F.col("committed_watermark_at")),
    )


def boundary_ids(items: DataFrame, states: DataFrame, hot: int | None = None) -> DataFrame:
    """Ids observed exactly at each scope's candidate watermark, one row each."""
    marks = states.filter("candidate_watermark_at IS NOT NULL").select("scope", "candidate_watermark_at")
    return (
        lookup(items, marks, ["scope"], "inner", hot)
        .filter(F.col("published_at") == F.col("candidate_watermark_at"))
        .select("scope", "source_comment_id", F.col("candidate_watermark_at").alias("watermark_at"))
        .distinct()
    )


def gap_intervals(runs: DataFrame, hot: int | None = None) -> DataFrame:
    """Intervals a capped run left unseen, and whether later runs covered them.

    `runs`: scope, run_number, continuity_status, oldest_observed_at, newest_observed_at,
    committed_watermark_at (before the run). The gap reaches from the watermark to the oldest
    item of the run; it closes when a later run of the scope gets back to the watermark.
    """
    # furthest reach back over all later runs: a running minimum from the newest run down
    reach = running_before(
        runs, ["scope"], [F.col("run_number").desc()], {"oldest_recovered_at": ("min", "oldest_observed_at")}, hot=hot
    )
    gaps = reach.filter(
        F.col("continuity_status").isin(*CAPPED_SCANS, "POTENTIAL_GAP") & F.col("committed_watermark_at").isNotNull()
    ).select(
        "scope",
        "run_number",
        F.col("committed_watermark_at").alias("gap_start_at"),
        F.col("oldest_observed_at").alias("gap_end_at"),
        "oldest_recovered_at",
    )
    status = (
        F.when(F.col("oldest_recovered_at") <= F.col("gap_start_at"), F.lit("GAP_CLOSED"))
        .when(F.col("oldest_recovered_at") < F.col("gap_end_at"), F.lit("PARTIALLY_RECOVERED"))
        .otherwise(F.lit("QUEUED"))
    )
    return gaps.withColumn("backfill_status", status)


def expected_units(
    channels: DataFrame, windows: Sequence[tuple[str, str]], frame_version_key: str, policy_version: str
) -> DataFrame:
    """Unit spine: every eligible channel x configured (window, search query).

    Windows and queries are run configuration, laid out as one array per channel row.
    """
    units = F.array(
        *[F.struct(F.lit(w).alias("window_key"), sha256(F.lit(q)).alias("query_hash")) for w, q in windows]
    )
    return channels.select(
        F.lit(frame_version_key).alias("frame_version_key"), "channel_key", F.explode(units).alias("_u")
    ).select(
        "frame_version_key", "channel_key", "_u.window_key", F.lit(policy_version).alias("discovery_policy_version"), "_u.query_hash"
    )


def unit_counts(expected: DataFrame, states: DataFrame) -> DataFrame:
    """Expected, completed and remaining units, with the audit verdict."""
    done = states.filter("status = 'COMPLETED'").select(*UNIT_KEYS).distinct().withColumn("_done", F.lit(True))
    return (
        expected.join(done, list(UNIT_KEYS), "left")
        .agg(
            F.count(F.lit(1)).alias("total_expected_units"),
            F.count_if("_done").alias("completed_units_count"),
        )
        .withColumn("remaining_units_count", F.col("total_expected_units") - F.col("completed_units_count"))
        .withColumn(
            "run_outcome", F.when(F.col("remaining_units_count") == 0, F.lit("COMPLETE")).otherwise(F.lit("PARTIAL"))
        )
    )


def remaining_units(expected: DataFrame, states: DataFrame) -> DataFrame:
    done = states.filter("status = 'COMPLETED'").select(*UNIT_KEYS)
    return expected.select(*UNIT_KEYS).join(done, list(UNIT_KEYS), "left_anti")


def cumulative_unit_ids(known: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct videos per unit over earlier runs and this one."""
    columns = [*UNIT_KEYS, "source_id"]
    return (
        known.select(*columns)
        .unionByName(current.select(*columns))
        .groupBy(*UNIT_KEYS)
        .agg(F.count_distinct("source_id").alias("unique_video_ids_observed"))
    )


def known_or_current(known: DataFrame, current: DataFrame, column: str = "source_id") -> DataFrame:
    return known.select(column).union(current.select(column)).distinct()


def publication_order(items: DataFrame, scope: str = "scope", hot: int | None = None) -> DataFrame:
    """Per scan: TRUE when no item is newer than the one before it."""
    ordered = neighbours(
        items.select(scope, "page_number", "item_position", "published_at"),
        [scope],
        [F.col("page_number"), F.col("item_position")],
        before={"_prev": "published_at"},
        hot=hot,
    )
    return ordered.groupBy(scope).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("published_at") > F.col("_prev")).alias("order_violations"),
    ).withColumn("is_monotonic", F.col("order_violations") == 0)


def run_telemetry(observations: DataFrame) -> DataFrame:
    """Pages, records, inserted and duplicate records per run.

    A record is inserted by the observation that saw its id first, over all runs.
    """
    first = observations.groupBy("source_comment_id").agg(
        F.min(F.struct("observed_at", "ingestion_run_id", "page_number", "item_position")).getField("ingestion_run_id").alias("ingestion_run_id")
    )
    inserted = first.groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("records_inserted"))
    observed = observations.groupBy("ingestion_run_id").agg(
        F.count_distinct("page_number").alias("pages_requested"), F.count(F.lit(1)).alias("records_observed")
    )
    return (
        observed.join(inserted, "ingestion_run_id", "left")
        .fillna(0, ["records_inserted"])
        .withColumn("duplicate_records_observed", F.col("records_observed") - F.col("records_inserted"))
    )


def observability(
    runs: DataFrame, requests: DataFrame, observations: DataFrame, checkpoints: DataFrame, backfill: DataFrame, quota: int
) -> DataFrame:
    """Ten pipeline health metrics as one row, each from one aggregate pass."""
    r = runs.agg(
        F.sum("records_inserted").alias("ins"),
        F.sum("records_observed").alias("obs"),
        F.sum("duplicate_records_observed").alias("dup"),
        F.sum("pages_requested").alias("pages"),
        F.count(F.lit(1)).alias("runs"),
        F.avg(seconds_between(F.col("started_at"), F.col("completed_at"))).alias("run_duration_seconds"),
    )
    q = requests.agg(
        F.try_divide(F.count_if(F.col("http_status") == 200), F.count(F.lit(1))).alias("request_success_rate"),
        (F.sum("estimated_quota_cost") / F.lit(float(quota))).alias("quota_consumption_rate"),
    )
    a = observations.agg(F.try_divide(F.count("author_key"), F.count(F.lit(1))).alias("author_id_coverage"))
    lag = micros_between(F.col("committed_watermark_at"), F.col("updated_at")) / F.lit(60_000_000.0)
    c = checkpoints.agg(F.max(lag).alias("watermark_lag_minutes"))
    b = backfill.agg(F.count_if(F.col("backfill_status").isin("QUEUED", "IN_PROGRESS")).alias("backfill_queue_depth"))
    # five one-row aggregates become one row: their union holds each value once
    parts = r
    for part in (q, a, c, b):
        parts = parts.unionByName(part, allowMissingColumns=True)
    one = parts.agg(*[F.max(x).alias(x) for x in parts.columns])
    return one.select(
        "request_success_rate",
        F.try_divide("pages", "runs").alias("pages_per_run"),
        F.try_divide("obs", "pages").alias("comments_per_page"),
        F.try_divide("ins", "obs").alias("new_comment_rate"),
        F.try_divide("dup", "obs").alias("duplicate_observation_rate"),
        "author_id_coverage",
        "watermark_lag_minutes",
        "backfill_queue_depth",
        "quota_consumption_rate",
        "run_duration_seconds",
    )


def reconcile_runs(
    runs: DataFrame,
    requests: DataFrame,
    raw_pages: DataFrame,
    observations: DataFrame,
    dead_letters: DataFrame,
    snapshots: DataFrame,
) -> DataFrame:
    """Six reconciliation checks per run and their conjunction.

    `raw_pages` carries item_count, the number of items in the payload; `requests` one row
    per attempt; `dead_letters` one row per quarantined item. Each input is counted on its own, by page or item first and
    then by run, so a run with most of the rows is combined by its finer keys; of each, one row for a run meets in a union.
    Inputs that lie by run already are counted where they lie.
    """
    key = "ingestion_run_id"
    one = F.lit(1)

    def ids(df: DataFrame) -> DataFrame:
        return df.groupBy(key, "source_comment_id").agg(F.count(one).alias("n")).groupBy(key)

    ok = F.coalesce(F.col("http_status") == 200, F.lit(False))
    attempts = requests.groupBy(key, "page_number").agg(F.count_if(ok).alias("n")).groupBy(key)
    counts = [
        runs.groupBy(key).agg(F.count(one).alias("runs"), F.max("pages_requested").cast("bigint").alias("pages_requested"), F.max("records_observed").cast("bigint").alias("records_observed")),
        attempts.agg(F.sum("n").alias("ok_requests"), F.count_if(F.col("n") == 0).alias("failed_pages")),
        raw_pages.groupBy(key).agg(F.count(one).alias("raw_pages"), F.sum("item_count").alias("raw_items")),
        ids(observations).agg(F.sum("n").alias("parsed_items"), F.count("source_comment_id").alias("parsed_ids")),
        dead_letters.groupBy(key).agg(F.count(one).alias("dead_items")),
        ids(snapshots).agg(F.count("source_comment_id").alias("snapshot_ids")),
    ]
    rows = counts[0]
    for part in counts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    joined = rows.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c != key]).filter("runs > 0")
    c = F.col
    checks = {
        "pages_persisted": c("ok_requests") == c("raw_pages"),
        "counts_reconcile": c("raw_items") == c("parsed_items") + c("dead_items"),
        "failures_in_dead_letter": (c("raw_items") - c("parsed_items")) == c("dead_items"),
        "writes_complete": c("parsed_ids") == c("snapshot_ids"),
        "no_failed_required_page": c("failed_pages") == 0,
        "counts_consistent": (c("pages_requested") == c("raw_pages")) & (c("records_observed") == c("parsed_items")),
    }
    out = joined.select(key, *[x.alias(n) for n, x in checks.items()])
    verdict = F.lit(True)
    for n in checks:
        verdict = verdict & F.col(n)
    return out.withColumn("reconciled", verdict)

