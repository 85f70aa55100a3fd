"""Comment pages to tables, one micro-batch at a time.

Each micro-batch lands its pages, parses them once, and brings six tables up to date under its batch id: raw
pages, dead letters, comments, text versions, changes of engagement and sample lineage. The marker of the batch comes
last, so readers never see a batch by halves, and a batch that failed between two tables is run again
without leaving a row twice. What the tables hold equals the batch operators over all pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlens.functions.keys import pseudonymise, sha256
from eventlens.operators import history
from eventlens.operators.ordered import has_hot_group
from eventlens.session import discard, scratch, short_shuffles, stored
from eventlens.sources.batches import Batch, BatchTables, Fixed, Layout
from eventlens.sources.landing import comment_items, land_raw, tag_dead_letters
from eventlens.sources.schemas import RAW_PAGE
from eventlens.streaming.incremental import page_stream

#: A snapshot's place among those of its comment.
_PLACE = ("observed_at", "raw_response_id", "item_position")
_VALUES = ("likes", "reply_count")
_BY_COMMENT = ("source_comment_id",)
#: A good item of a batch, and how it stands to those before it; what is the same in the whole batch isn't dealt.
_SNAPSHOT = (
    "source_comment_id string, video_key string, published_at timestamp_ntz, author_key string, text_content string, text_hash string, "
    "likes bigint, reply_count bigint, item_position bigint, raw_response_id string, observed_at timestamp_ntz, _late boolean, _changed boolean"
)


def layouts(buckets: int = 64) -> dict[str, Layout]:
    return {
        "raw_page": Layout(RAW_PAGE),
        "dead_letter": Layout("source_comment_id string, raw_response_id string, item_position bigint, observed_at timestamp_ntz, error_code string"),
        "comment": Layout(
            "source_comment_id string, comment_key string, published_at timestamp_ntz, observed_at timestamp_ntz, page_number string, "
            "item_position bigint, video_key string, author_key string, observations bigint, "
            "last struct<observed_at: timestamp_ntz, raw_response_id: string, item_position: bigint, likes: bigint, reply_count: bigint>",
            _BY_COMMENT,
            buckets,
        ),
        "text_version": Layout(
            "source_comment_id string, text_hash string, text_content string, observed_at timestamp_ntz, last_observed_at timestamp_ntz",
            ("source_comment_id", "text_hash"),
            buckets,
        ),
        "engagement": Layout(
            "source_comment_id string, observed_at timestamp_ntz, raw_response_id string, item_position bigint, likes bigint, reply_count bigint, "
            "ingestion_run_id string"
        ),
        "sample_observation": Layout("comment_key string, raw_response_id string, source_item_position bigint, sample_type string, observed_at timestamp_ntz"),
        "snapshot": Layout(_SNAPSHOT, _BY_COMMENT, buckets, working=True),
    }


def comment_tables(spark: SparkSession, root: str, prefix: str, buckets: int = 64) -> BatchTables:
    return BatchTables(spark, root, layouts(buckets), prefix)


def parsed(landed: DataFrame, sample_type: str, secrets: dict[str, bytes], salt_version: str) -> DataFrame:
    """Items of landed pages with the author's pseudonym and `error_code`, NULL for a good one."""
    items = comment_items(landed).withColumn("salt_version_id", F.lit(salt_version))
    named = pseudonymise(items, "author_channel_id", secrets, "author_key").drop("author_channel_id", "salt_version_id")
    named = named.withColumns({"page_number": F.col("raw_response_id"), "sample_type": F.lit(sample_type)})
    return tag_dead_letters(
        named, {"MISSING_ID": F.col("source_comment_id").isNotNull(), "BAD_TIMESTAMP": F.col("published_at").isNotNull()}
    )


def ingest(
    tables: BatchTables, pages: DataFrame, batch_id: int, run_id: str, sample_type: str, secrets: dict[str, bytes], salt_version: str
) -> None:
    """One micro-batch of pages into all tables; a batch that is marked already is left alone.

    Pages are parsed once, and snapshots are dealt once, as the buckets of the comments are: what is made of them for each
    comment is not shuffled, but for their texts. If one comment has more snapshots than a task should take, they
    stay where they are, and are combined before they are dealt. Nothing stays on disk longer than it is read: neither the
    items, nor the snapshots, nor what is shuffled, nor the states that this batch replaces. So a reader of an earlier
    state has to be done when the next batch ends.
    """
    if tables.is_marked(batch_id):
        return
    rows = [scratch(tables.spark, "rows") for _ in range(2)]
    with short_shuffles(tables.spark):
        try:
            with tables.batch(batch_id) as batch:
                _fill(batch, pages, rows, run_id, sample_type, secrets, salt_version)
        finally:
            for path in rows:
                discard(tables.spark, path)
        for name in ("comment", "text_version"):
            tables.drop_superseded(name)


def _fill(batch: Batch, pages: DataFrame, rows: list[str], run_id: str, sample_type: str, secrets: dict[str, bytes], salt_version: str) -> None:
    """The writes of a micro-batch; `rows` are folders for its items, and for its snapshots if a comment is hot."""
    tables = batch.tables
    landed = batch.append("raw_page", land_raw(pages, "VIDEO", "VIDEO", "commentThreads.list", run_id))
    items = stored(parsed(landed, sample_type, secrets, salt_version).withColumn("text_hash", sha256(F.col("text_content"))), rows[0])
    good, layout = items.filter("error_code IS NULL"), tables.layouts["snapshot"]
    batch.append("sample_observation", history.sample_observations(good))
    # a comment is counted by itself only if its bucket is as large as a hot comment alone
    is_hot = has_hot_group(good.select(layout.bucket().alias("bucket")), ["bucket"]) and has_hot_group(good, _BY_COMMENT)
    known = tables.live("comment").filter("last IS NOT NULL").select(*_BY_COMMENT, "last.*")
    snapshots = good.select(*[c for c in layout.names if c in good.columns])
    dealt = snapshots if is_hot else snapshots.repartition(layout.buckets, *_BY_COMMENT)
    seen = history.marked_since(known, dealt, *_BY_COMMENT, _PLACE, _VALUES, is_hot=is_hot)
    seen = stored(seen, rows[1]) if is_hot else batch.keep("snapshot", seen)
    seen = seen.withColumns({"page_number": F.col("raw_response_id"), "ingestion_run_id": F.lit(run_id)})
    late = seen.filter("_late").withColumn("error_code", F.lit("LATE_SNAPSHOT"))
    batch.append("dead_letter", items.filter("error_code IS NOT NULL").unionByName(late, allowMissingColumns=True))
    discard(tables.spark, rows[0])
    batch.append("engagement", seen.filter("_changed"))
    states = {"text_version": history.text_states(seen), "comment": history.comment_states(seen, _PLACE, _VALUES)}
    for name, fold in (("text_version", history.fold_text_states), ("comment", history.fold_comments)):
        batch.merge(name, Fixed(states[name], tables.buckets_of(name, seen)), fold)


def ingest_pages(
    tables: BatchTables,
    path: str,
    checkpoint: str,
    run_id: str,
    sample_type: str,
    secrets: dict[str, bytes],
    salt_version: str,
    max_files: int = 1000,
) -> StreamingQuery:
    """Take the page files that have arrived since the checkpoint, and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(tables, batch, batch_id, run_id, sample_type, secrets, salt_version)

    query = (
        page_stream(tables.spark, path, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def comments(tables: BatchTables) -> DataFrame:
    """As `history.canonical_comments`."""
    return tables.live("comment").select(
        "comment_key",
        "source_comment_id",
        "video_key",
        "author_key",
        "published_at",
        F.col("observed_at").alias("first_observed_at"),
        (F.col("observations") - 1).alias("duplicate_observations"),
    )


def text_versions(tables: BatchTables) -> DataFrame:
    """As `history.text_versions`, with the text."""
    return history.with_latest(tables.live("text_version"))
