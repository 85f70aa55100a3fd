"""Raw pages and their normalisation.

Pages are landed verbatim, hashed, before anything is parsed; every normaliser reads only
landed pages, so replaying a subset of them is the same function on a filtered table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.keys import md5_uuid, sha256
from eventlens.functions.text import language_code, stored_description
from eventlens.functions.times import duration_seconds, utc_ntz
from eventlens.operators.joins import missing_from
from eventlens.operators.ordered import latest_per_key
from eventlens.sources import schemas

PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def land_raw(pages: DataFrame, source_system: str, scope_type: str, endpoint: str, run_id: str) -> DataFrame:
    """The sixteen canonical raw columns around an untouched payload.

    `pages` has resource_scope_id, page_token_used, next_page_token_returned, request_parameters,
    http_status, retrieved_at, raw_json_payload. Keys derive from the request, so landing the
    same pages again gives the same rows.
    """
    request = md5_uuid(
        F.lit(run_id),
        F.lit(endpoint),
        F.col("resource_scope_id"),
        F.coalesce(F.col("page_token_used"), F.lit("")),
        F.col("retrieved_at"),
    )
    landed = pages.withColumns(
        {
            "api_request_id": request,
            "raw_response_id": md5_uuid(request, sha256(F.col("raw_json_payload"))),
            "ingestion_run_id": F.lit(run_id),
            "source_system": F.lit(source_system),
            "endpoint": F.lit(endpoint),
            "resource_scope_type": F.lit(scope_type),
            "resource_scope_id": F.col("resource_scope_id").cast("string"),
            "http_status": F.col("http_status").cast("smallint"),
            "payload_hash": sha256(F.col("raw_json_payload")),
            "parser_version": F.lit(None).cast("string"),
            "source_schema_version": F.lit(None).cast("string"),
        }
    )
    return landed.select(*schemas.RAW_PAGE_COLUMNS)


def append_raw(landed: DataFrame, path: str) -> None:
    landed.write.mode("append").partitionBy("endpoint").parquet(path)


def read_raw(
    spark: SparkSession, path: str, run_id: str | None = None, raw_response_id: str | None = None
) -> DataFrame:
    """Landed pages, optionally one run or one page, for processing or offline replay."""
    raw = spark.read.schema(schemas.RAW_PAGE).parquet(path)
    return replay(raw, run_id, raw_response_id)


def replay(raw: DataFrame, run_id: str | None = None, raw_response_id: str | None = None) -> DataFrame:
    if run_id is not None:
        raw = raw.filter(F.col("ingestion_run_id") == run_id)
    if raw_response_id is not None:
        raw = raw.filter(F.col("raw_response_id") == raw_response_id)
    return raw


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("_page", F.from_json("raw_json_payload", schema, PERMISSIVE))


def _page_items(payload: str = "raw_json_payload") -> Column:
    """The items of a page as VARIANT values; NULL if the payload is no JSON or has no list of items."""
    return F.try_variant_get(F.try_parse_json(payload), "$.items", "array<variant>")


def _items(raw: DataFrame) -> DataFrame:
    """One row per item, `item` a VARIANT: a page is parsed once, and an item of any form stands beside its siblings."""
    lineage = ["raw_response_id", "api_request_id", "ingestion_run_id", "resource_scope_id", "retrieved_at"]
    return raw.select(*lineage, F.posexplode(_page_items()).alias("item_position", "item"))


def _get(path: str) -> Column:
    """The text at a path of the item; NULL where there is none."""
    return F.try_variant_get("item", f"$.{path}", "string")


def comment_items(raw: DataFrame) -> DataFrame:
    """One row per top-level comment and page position, defaults filled; malformed items have NULLs."""
    said = "snippet.topLevelComment.snippet"
    return _items(raw).select(
        _get("id").alias("source_comment_id"),
        F.col("resource_scope_id").alias("video_key"),
        utc_ntz(_get(f"{said}.publishedAt")).alias("published_at"),
        _get(f"{said}.authorChannelId.value").alias("author_channel_id"),
        F.coalesce(_get(f"{said}.textOriginal"), F.lit("")).alias("text_content"),
        F.coalesce(_get(f"{said}.likeCount").try_cast("bigint"), F.lit(0)).alias("likes"),
        F.coalesce(_get("snippet.totalReplyCount").try_cast("bigint"), F.lit(0)).alias("reply_count"),
        F.col("item_position").cast("bigint").alias("item_position"),
        "raw_response_id",
        "ingestion_run_id",
        F.col("retrieved_at").alias("observed_at"),
    )


def video_items(raw: DataFrame) -> DataFrame:
    """One row per returned video; unreadable counts are NULL, short state stays unknown."""
    return (
        _items(raw)
        .withColumn("source_id", _get("id"))
        .filter("source_id IS NOT NULL")
        .select(
            "source_id",
            _get("snippet.channelId").alias("channel_source_id"),
            F.coalesce(_get("snippet.title"), F.lit("")).alias("title"),
            stored_description(_get("snippet.description")).alias("description"),
            utc_ntz(_get("snippet.publishedAt")).alias("published_at"),
            duration_seconds(_get("contentDetails.duration")).alias("duration_seconds"),
            F.lit(None).cast("boolean").alias("is_short"),
            language_code(_get("snippet.defaultAudioLanguage"), _get("snippet.defaultLanguage")).alias("primary_language_code"),
            _get("statistics.viewCount").try_cast("bigint").alias("views"),
            _get("statistics.likeCount").try_cast("bigint").alias("likes"),
            F.col("item_position").cast("bigint").alias("item_position"),
            "raw_response_id",
            "api_request_id",
            "ingestion_run_id",
            F.col("retrieved_at").alias("observed_at"),
        )
    )


def listing_items(raw: DataFrame) -> DataFrame:
    """Search and playlist items; an item without video id or time is skipped.

    A search result has an object as id, a playlist item a text; only the object form has a video id.
    """
    video_id = F.coalesce(_get("id.videoId"), _get("contentDetails.videoId"), _get("snippet.resourceId.videoId"))
    return (
        _items(raw)
        .select(
            video_id.alias("source_id"),
            utc_ntz(_get("snippet.publishedAt")).alias("published_at"),
            _get("snippet.title").alias("title"),
            F.col("item_position").cast("bigint").alias("item_position"),
            "raw_response_id",
            F.col("resource_scope_id").alias("scope"),
        )
        .filter("source_id IS NOT NULL AND published_at IS NOT NULL")
    )


def requested_ids(raw: DataFrame) -> DataFrame:
    """Ids each page was asked for, from its stored request; else the ids it returned."""
    request = F.from_json("request_parameters", schemas.REQUEST_PARAMETERS)["requested_video_ids"]
    returned = F.transform(_page_items(), lambda i: F.try_variant_get(i, "$.id", "string"))
    return raw.select("raw_response_id", F.explode(F.coalesce(request, returned)).alias("source_id")).filter(
        "source_id IS NOT NULL"
    )


def unavailable_ids(raw: DataFrame) -> DataFrame:
    """Requested ids a page did not return."""
    return missing_from(requested_ids(raw), video_items(raw), ["raw_response_id", "source_id"]).distinct()


def cascade_unavailable(video_events: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Links of unavailable videos become ineligible; all other links pass through."""
    gone = unavailable.select("source_id").distinct().withColumn("_gone", F.lit(True))
    is_gone = F.col("_gone").isNotNull()
    return (
        video_events.join(gone, "source_id", "left")
        .withColumn(
            "inclusion_status", F.when(is_gone, F.lit("INELIGIBLE")).otherwise(F.col("inclusion_status"))
        )
        .withColumn(
            "primary_exclusion_reason",
            F.when(is_gone, F.lit("VIDEO_UNAVAILABLE")).otherwise(F.col("primary_exclusion_reason")),
        )
        .drop("_gone")
    )


def page_checks(raw: DataFrame, schema: str, item_id: str, item_time: Column) -> DataFrame:
    """Validation flags per page: structure, ids, timestamps, pagination.

    Counting happens inside each page's own item array, so no item is shuffled.
    """
    parsed = _parsed(raw, schema)
    items = F.coalesce(F.col("_page.items"), F.array())
    return parsed.select(
        "raw_response_id",
        F.col("_page.items").isNotNull().alias("has_items"),
        F.col("_page._corrupt_record").isNull().alias("parseable"),
        F.size(items).cast("bigint").alias("item_count"),
        F.size(F.filter(items, lambda i: i[item_id].isNull())).cast("bigint").alias("missing_ids"),
        F.size(F.filter(items, lambda i: utc_ntz(item_time(i)).isNull())).cast("bigint").alias("bad_timestamps"),
        F.col("next_page_token_returned").eqNullSafe(F.col("_page.nextPageToken")).alias("pagination_consistent"),
    )


def tag_dead_letters(items: DataFrame, required: dict[str, Column]) -> DataFrame:
    """Adds error_code: NULL for a good item, else the first condition it misses.

    `required` maps an error code to the condition a good row fulfils.
    """
    reason = F.lit(None).cast("string")
    for code, good in reversed(list(required.items())):
        reason = F.when(~F.coalesce(good, F.lit(False)), F.lit(code)).otherwise(reason)
    return items.withColumn("error_code", reason)


def split_dead_letters(items: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows; the latter keep the raw reference and the reason."""
    tagged = tag_dead_letters(items, required)
    return tagged.filter("error_code IS NULL").drop("error_code"), tagged.filter("error_code IS NOT NULL")


def new_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshots of (video, request) pairs not stored yet; replays add nothing.

    A video a page lists twice counts with its last position.
    """
    keys = ["source_id", "api_request_id"]
    last = latest_per_key(incoming, keys, [F.col("item_position").desc(), F.col("raw_response_id")])
    return last.join(existing.select(*keys), keys, "left_anti")
