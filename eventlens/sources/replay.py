"""Replay of stored video pages: snapshots, lifecycle, resolution state and links, without a request.

Every table takes the pages' rows by a rule that changes nothing when it sees them again, so a replay may be
repeated, over all pages or over some, and a second one leaves the tables as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import history
from eventlens.session import stored
from eventlens.sources.batches import BatchTables, Fixed, Layout
from eventlens.sources.landing import cascade_unavailable, new_snapshots, requested_ids, video_items

_VIDEO = "published_at timestamp_ntz, duration_seconds bigint, is_short boolean, short_classification_rule_version string, primary_language_code string"
_STATE = (
    "resolution_status string, first_discovered_at timestamp_ntz, resolved_at timestamp_ntz, updated_at timestamp_ntz, "
    "last_error_code string, retry_count bigint, last_attempt_id string"
)


def video_tables(spark: SparkSession, root: str, prefix: str, buckets: int = 64) -> BatchTables:
    return BatchTables(
        spark,
        root,
        {
            "snapshot": Layout("source_id string, api_request_id string, observed_at timestamp_ntz, title string, views bigint, likes bigint, raw_response_id string"),
            "video": Layout(f"source_id string, {_VIDEO}", ("source_id",), buckets),
            "resolution": Layout(f"source_id string, {_STATE}", ("source_id",), buckets),
            "link": Layout("source_id string, event_version_key string, inclusion_status string, primary_exclusion_reason string", ("source_id", "event_version_key"), buckets),
        },
        prefix,
    )


def attempts(raw: DataFrame, items: DataFrame) -> DataFrame:
    """One attempt per requested id and page: RESOLVED if the page returned it, else UNAVAILABLE."""
    pages = raw.select("raw_response_id", "retrieved_at")
    returned = items.select("raw_response_id", "source_id").distinct().withColumn("_there", F.lit(True))
    asked = requested_ids(raw).distinct().join(returned, ["raw_response_id", "source_id"], "left").join(pages, "raw_response_id")
    there = F.col("_there").isNotNull()
    return asked.select(
        "source_id",
        F.col("retrieved_at").alias("attempted_at"),
        F.col("raw_response_id").alias("attempt_id"),
        F.when(there, F.lit("RESOLVED")).otherwise(F.lit("UNAVAILABLE")).alias("status"),
        F.when(~there, F.lit("NOT_RETURNED")).alias("error_code"),
        F.lit(0).cast("bigint").alias("retry_count"),
    )


def replay_videos(tables: BatchTables, raw: DataFrame, batch_id: int) -> None:
    """Take stored pages of videos into all tables, as one batch.

    A video's newest page decides its lifecycle values where they aren't frozen yet.
    """
    with tables.batch(batch_id) as batch:
        items = stored(video_items(raw))
        batch.append("snapshot", new_snapshots(tables.live("snapshot"), items))
        newest = F.max(F.struct("observed_at", "raw_response_id", "item_position", "published_at", "duration_seconds", "is_short", "primary_language_code"))
        seen = items.groupBy("source_id").agg(newest.alias("_v")).select("source_id", "_v.published_at", "_v.duration_seconds", "_v.is_short", "_v.primary_language_code")
        seen = seen.withColumn("short_classification_rule_version", F.lit(None).cast("string"))
        batch.merge("video", Fixed(seen, tables.buckets_of("video", items)), lambda old, new: history.freeze_once(old, new, ["source_id"]))
        tried = stored(attempts(raw, items))
        state = history.resolution_state(tried, with_attempt=True)
        batch.merge("resolution", Fixed(state, tables.buckets_of("resolution", tried)), history.fold_resolution)
        gone = tried.filter("status = 'UNAVAILABLE'").select("source_id").distinct()
        known = tables.live("link").join(gone, "source_id", "left_semi")
        batch.merge("link", known, cascade_unavailable)
