"""Landing, normalisation, replay, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.config import Frame
from eventlens.functions.times import ntz
from eventlens.operators.strata import latest_about
from eventlens.operators.windows import assign_windows, window_table
from eventlens.plans.catalog.base import EVENT_1, EVENT_2, comments, query, table, videos
from eventlens.plans.catalog.history import UUID
from eventlens.sources import landing, schemas
from eventlens.sources.reference_data import event_rows, first_versions, frame_tables

RETRIEVED = "2024-02-01 00:00:00"


def _pages(scope, payload, retrieved=None, request=None, token=None, next_token=None):
    """Columns of an arriving page."""
    none = F.lit(None).cast("string")
    return [
        scope.cast("string").alias("resource_scope_id"),
        (token if token is not None else none).alias("page_token_used"),
        (next_token if next_token is not None else none).alias("next_page_token_returned"),
        (request if request is not None else none).alias("request_parameters"),
        F.lit(200).alias("http_status"),
        (retrieved if retrieved is not None else ntz(RETRIEVED)).alias("retrieved_at"),
        payload.alias("raw_json_payload"),
    ]




@query(
    "s1_land_raw",
    f"""SELECT url AS resource_scope_id, api_request_id, sha256(html) AS payload_hash, length(html) AS payload_length,
      {UUID.format("api_request_id || ':' || sha256(html)")} AS raw_response_id, 'pages.list' AS endpoint, 'run1' AS ingestion_run_id
    FROM (SELECT *, {UUID.format("'run1:pages.list:' || url || '::2024-02-01 00:00:00'")} AS api_request_id FROM pages)""",
)
def _s1(spark, sf):
    pages = table(spark, sf, "pages").select(*_pages(F.col("url"), F.col("html")))
    return landing.land_raw(pages, "WEB", "PAGE", "pages.list", "run1").select(
        "resource_scope_id",
        "api_request_id",
        "payload_hash",
        F.char_length("raw_json_payload").cast("bigint").alias("payload_length"),
        "raw_response_id",
        "endpoint",
        "ingestion_run_id",
    )


@query(
    "s2_land_playlist",
    f"""SELECT CAST(conv_id AS VARCHAR) AS resource_scope_id, 'PLAYLIST' AS resource_scope_type,
      CASE WHEN turn > 0 THEN 'p' || turn END AS page_token_used, 'p' || (turn + 1) AS next_page_token_returned,
      {UUID.format("'run1:playlistItems.list:' || conv_id || ':' || CASE WHEN turn > 0 THEN 'p' || turn ELSE '' END || ':2024-02-01 00:00:00'")}
        AS api_request_id, sha256(text) AS payload_hash FROM conversations""",
)
def _s2(spark, sf):
    turn = F.col("turn")
    token = F.when(turn > 0, F.concat(F.lit("p"), turn.cast("string")))
    after = F.concat(F.lit("p"), (turn + 1).cast("string"))
    pages = table(spark, sf, "conversations").select(
        *_pages(F.col("conv_id"), F.col("text"), token=token, next_token=after)
    )
    return landing.land_raw(pages, "VIDEO", "PLAYLIST", "playlistItems.list", "run1").select(
        "resource_scope_id",
        "resource_scope_type",
        "page_token_used",
        "next_page_token_returned",
        "api_request_id",
        "payload_hash",
    )


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def video_pages(spark, sf):
    """One page per document: it asks for the document and its ghost, and returns the document.

    Counts are unreadable on every eighth page and absent on every ninth.
    """
    d = F.col("doc_id")
    views = F.when(d % 8 == 0, F.lit("n/a")).when(d % 9 != 0, F.col("n_chars").cast("string"))
    duration = F.concat(F.lit("PT"), (F.col("n_chars") % 99).cast("string"), F.lit("M5S"))
    item = F.struct(
        d.cast("string").alias("id"),
        F.struct(
            "title",
            "description",
            _iso("published_at").alias("publishedAt"),
            F.col("channel_key").alias("channelId"),
            F.when(d % 2 == 0, F.upper("lang")).alias("defaultAudioLanguage"),
            F.when(d % 3 == 0, F.col("lang")).alias("defaultLanguage"),
        ).alias("snippet"),
        F.struct(duration.alias("duration")).alias("contentDetails"),
        F.struct(views.alias("viewCount"), F.lit("5").alias("likeCount")).alias("statistics"),
    )
    ids = F.array(d.cast("string"), F.concat(F.lit("ghost"), d.cast("string")))
    request = F.to_json(F.struct(F.lit("snippet").alias("part"), ids.alias("requested_video_ids"), F.lit(2).alias("id_count")))
    # one page in eleven lost its stored request
    request = F.when(d % 11 != 0, request)
    payload = F.to_json(F.struct(F.array(item).alias("items")))
    pages = videos(spark, sf).select(*_pages(d, payload, request=request))
    return landing.land_raw(pages, "VIDEO", "VIDEO_BATCH", "videos.list", "run1")


_VIDEO_ITEMS = """SELECT CAST(doc_id AS VARCHAR) AS source_id, channel_key AS channel_source_id, title,
    substr(description, 1, 4900) AS description, published_at, (n_chars % 99) * 60 + 5 AS duration_seconds,
    CASE WHEN doc_id % 6 IN (0, 2, 3, 4) THEN lower(lang) ELSE 'UNKNOWN' END AS primary_language_code,
    CASE WHEN doc_id % 8 <> 0 AND doc_id % 9 <> 0 THEN n_chars END AS views, 5::BIGINT AS likes FROM videos"""


@query("s3_video_normalise", _VIDEO_ITEMS, "videos")
def _s3(spark, sf):
    return landing.video_items(video_pages(spark, sf)).select(
        "source_id",
        "channel_source_id",
        "title",
        "description",
        "published_at",
        "duration_seconds",
        "primary_language_code",
        "views",
        "likes",
    )


def comment_page_rows(spark, sf, run=0):
    """Two comments per page: the event and a second one with its optional fields missing.

    Some ids are absent and some times unreadable, for the dead-letter split. Run r retrieves r days later; the
    second run sees edits and more likes.
    """
    e = F.col("event_id")

    def item(cid, published, author, body, likes, replies):
        return F.struct(
            cid.alias("id"),
            F.struct(
                replies.cast("bigint").alias("totalReplyCount"),
                F.struct(
                    F.struct(
                        published.alias("publishedAt"),
                        F.when(author.isNotNull(), F.struct(author.cast("string").alias("value"))).alias("authorChannelId"),
                        body.cast("string").alias("textOriginal"),
                        likes.cast("bigint").alias("likeCount"),
                    ).alias("snippet")
                ).alias("topLevelComment"),
            ).alias("snippet"),
        )

    later = F.lit(run == 2)
    text = F.concat("event_type", F.when(later & (e % 5 == 0), F.lit(" edited")).otherwise(F.lit("")))
    likes = F.floor("value") + F.when(later & (e % 3 == 0), 1).otherwise(0)
    cid = F.when(e % 97 != 0, F.concat(F.lit("c"), e.cast("string")))
    published = F.when(e % 89 == 0, F.lit("not a time")).otherwise(_iso("ts"))
    none = F.lit(None)
    first = item(cid, published, F.when(F.col("user_id") % 10 != 0, F.col("user_id")), text, likes, e % 4)
    second = item(F.concat(F.lit("d"), e.cast("string")), _iso("ts"), none.cast("bigint"), none, none, none)
    more = F.when(e % 2 == 0, F.concat(F.lit("t"), e.cast("string")))
    payload = F.to_json(F.struct(F.array(first, second).alias("items"), more.alias("nextPageToken")))
    video = F.get_json_object("props", "$.k")
    retrieved = F.col("ts") + F.make_dt_interval(F.lit(run))
    return table(spark, sf, "events").select(*_pages(video, payload, retrieved=retrieved, next_token=more), "event_id")


def comment_pages(spark, sf):
    pages = comment_page_rows(spark, sf).drop("event_id")
    return landing.land_raw(pages, "VIDEO", "VIDEO", "commentThreads.list", "run1")


_COMMENT_ITEMS = """
  SELECT CASE WHEN event_id % 97 <> 0 THEN 'c' || event_id END AS source_comment_id, json_extract_string(props, '$.k') AS video_key,
    CASE WHEN event_id % 89 <> 0 THEN ts END AS published_at,
    CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS author_channel_id, event_type AS text_content,
    CAST(floor(value) AS BIGINT) AS likes, event_id % 4 AS reply_count, 0::BIGINT AS item_position, ts AS observed_at FROM events
  UNION ALL SELECT 'd' || event_id, json_extract_string(props, '$.k'), ts, NULL, '', 0, 0, 1, ts FROM events
"""


@query("s4_comment_normalise", _COMMENT_ITEMS)
def _s4(spark, sf):
    return landing.comment_items(comment_pages(spark, sf)).drop("raw_response_id", "ingestion_run_id")


@query(
    "s5_listing_normalise",
    """SELECT CAST(CASE conv_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'p' ELSE 'r' END AS VARCHAR) || conv_id || '-' || turn AS source_id,
      timestamp '2024-01-01' + to_hours(turn) AS published_at, text AS title, 0::BIGINT AS item_position
    FROM conversations WHERE turn % 4 <> 3""",
)
def _s5(spark, sf):
    """Search results, playlist items by content and by resource; every fourth item has no id."""
    c, t = F.col("conv_id"), F.col("turn")
    key = F.concat_ws("-", c.cast("string"), t.cast("string"))
    video = F.when(t % 4 != 3, F.concat(F.when(c % 3 == 0, "s").when(c % 3 == 1, "p").otherwise("r"), key))
    resource = F.when(c % 3 == 2, F.struct(video.alias("videoId")))
    published = _iso(ntz("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), t.cast("int")))
    item = F.struct(
        F.when(c % 3 == 0, F.struct(video.alias("videoId"))).alias("id"),
        F.struct(published.alias("publishedAt"), F.col("text").alias("title"), resource.alias("resourceId")).alias("snippet"),
        F.when(c % 3 == 1, F.struct(video.alias("videoId"))).alias("contentDetails"),
    )
    pages = table(spark, sf, "conversations").select(*_pages(c, F.to_json(F.struct(F.array(item).alias("items")))))
    raw = landing.land_raw(pages, "VIDEO", "CHANNEL", "search.list", "run1")
    return landing.listing_items(raw).select("source_id", "published_at", "title", "item_position")


@query(
    "s6_channel_about",
    """SELECT source AS source_channel_id, text AS about_description FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 100003 DESC, doc_id DESC) = 1""",
)
def _s6(spark, sf):
    """Every document as a channels page of its source; the newest retrieval wins."""
    d = F.col("doc_id")
    at = ntz("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((d * 7919) % 100003).cast("decimal(18,6)"))
    payload = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("description")).alias("snippet"))).alias("items"))
    )
    pages = table(spark, sf, "documents").select(*_pages(F.col("source"), payload, retrieved=at), "doc_id")
    raw = landing.land_raw(pages.drop("doc_id"), "VIDEO", "CHANNEL", "channels.list", "run1")
    return latest_about(raw).select("source_channel_id", "about_description")


@query(
    "s7_offline_replay",
    """SELECT CAST(doc_id AS VARCHAR) AS source_id, 'SNAPSHOT' AS outcome FROM videos WHERE doc_id % 2 = 1
    UNION ALL SELECT 'ghost' || doc_id, 'UNAVAILABLE' FROM videos WHERE doc_id % 11 <> 0""",
    "videos",
)
def _s7(spark, sf):
    """Replay of stored pages over a half-filled snapshot table: only missing snapshots appear."""
    raw = landing.replay(video_pages(spark, sf), run_id="run1")
    items = landing.video_items(raw)
    stored = items.filter(F.col("source_id").cast("bigint") % 2 == 0).select("source_id", "api_request_id")
    fresh = landing.new_snapshots(stored, items).select("source_id", F.lit("SNAPSHOT").alias("outcome"))
    gone = landing.unavailable_ids(raw).select("source_id", F.lit("UNAVAILABLE").alias("outcome"))
    return fresh.unionByName(gone)


@query(
    "s8_dead_letters",
    """SELECT CASE WHEN event_id % 97 = 0 THEN 'MISSING_ID' WHEN event_id % 89 = 0 THEN 'BAD_TIMESTAMP' ELSE 'VALID' END AS outcome,
      count(*) AS items FROM (SELECT event_id FROM events UNION ALL SELECT 1 FROM events) GROUP BY ALL""",
)
def _s8(spark, sf):
    items = landing.comment_items(comment_pages(spark, sf))
    tagged = landing.tag_dead_letters(
        items,
        {
            "MISSING_ID": F.col("source_comment_id").isNotNull(),
            "BAD_TIMESTAMP": F.col("published_at").isNotNull(),
        },
    )
    outcome = F.coalesce("error_code", F.lit("VALID")).alias("outcome")
    return tagged.groupBy(outcome).agg(F.count(F.lit(1)).alias("items"))


@query(
    "s9_page_checks",
    """SELECT has_items, parseable, item_count, missing_ids, bad_timestamps, pagination_consistent, count(*) AS pages FROM (
      SELECT TRUE AS has_items, TRUE AS parseable, 2::BIGINT AS item_count, (event_id % 97 = 0)::BIGINT AS missing_ids,
        (event_id % 89 = 0)::BIGINT AS bad_timestamps, TRUE AS pagination_consistent FROM events
      UNION ALL SELECT FALSE, FALSE, 0, 0, 0, TRUE FROM pages) GROUP BY ALL""",
)
def _s9(spark, sf):
    """Comment pages and web pages through the same checks; HTML is no valid payload."""
    web = table(spark, sf, "pages").select(*_pages(F.col("url"), F.col("html")))
    raw = comment_pages(spark, sf).unionByName(landing.land_raw(web, "WEB", "PAGE", "pages.list", "run1"))
    time = lambda i: i["snippet"]["topLevelComment"]["snippet"]["publishedAt"]
    checks = landing.page_checks(raw, schemas.COMMENT_PAGE, "id", time)
    return checks.groupBy(*[c for c in checks.columns if c != "raw_response_id"]).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "s10_config_load",
    """SELECT w.event_version_key AS event_key, event_terms, baseline_terms, occurred_at, count(comment_key) AS comments_in_windows
    FROM windows2 w JOIN comments c ON c.published_at >= start_at AND c.published_at < end_at
    JOIN (VALUES ('EV1', 'oning,ontion', 'nicht,this'), ('EV2', 'intion,reing', 'from,with')) t(event_version_key, event_terms, baseline_terms)
      USING (event_version_key) GROUP BY ALL""",
    "windows2 comments",
)
def _s10(spark, sf):
    events = [EVENT_1, EVENT_2]
    dimension = first_versions(event_rows(spark, events), ["event_key"], EVENT_1.occurred_at)
    counts = (
        assign_windows(comments(spark, sf).select("comment_key", "published_at"), window_table(spark, events))
        .groupBy(F.col("event_version_key").alias("event_key"))
        .agg(F.count(F.lit(1)).alias("comments_in_windows"))
    )
    return dimension.join(counts, "event_key").select(
        "event_key",
        F.array_join("event_terms", ",").alias("event_terms"),
        F.array_join("baseline_terms", ",").alias("baseline_terms"),
        "occurred_at",
        "comments_in_windows",
    )


@query(
    "j6_new_snapshots",
    """SELECT CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _j6(spark, sf):
    items = landing.video_items(video_pages(spark, sf))
    known = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_id"))
    stored = items.select("source_id", "api_request_id").join(known, "source_id", "left_semi")
    return landing.new_snapshots(stored, items).select("source_id")


@query(
    "j7_unavailable_cascade",
    """SELECT CAST(doc_id AS VARCHAR) AS source_id, 'ELIGIBLE' AS inclusion_status, NULL AS primary_exclusion_reason FROM documents
    UNION ALL SELECT 'ghost' || doc_id, CASE WHEN doc_id % 11 <> 0 THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END,
      CASE WHEN doc_id % 11 <> 0 THEN 'VIDEO_UNAVAILABLE' END FROM documents""",
)
def _j7(spark, sf):
    d = F.col("doc_id").cast("string")
    links = table(spark, sf, "documents").select(F.explode(F.array(d, F.concat(F.lit("ghost"), d))).alias("source_id"))
    links = links.select(
        "source_id",
        F.lit("ELIGIBLE").alias("inclusion_status"),
        F.lit(None).cast("string").alias("primary_exclusion_reason"),
    )
    return landing.cascade_unavailable(links, landing.unavailable_ids(video_pages(spark, sf)))


@query(
    "s10_frame_load",
    f"""SELECT {UUID.format("'VIDEO:' || c_name")} AS channel_key, c_name AS source_id, 'ELIGIBLE' AS frame_inclusion_status,
      {UUID.format(UUID.format("sha256('{}')") + " || ':' || " + UUID.format("'VIDEO:' || c_name"))} AS frame_channel_key,
      c_mktsegment AS discovery_source FROM customer""",
)
def _s10_frame(spark, sf):
    """Customers as the channels of a panel; their segment is the discovery source."""
    frame = Frame("Panel", "RESEARCH", "1.2", "{}", code_version="v1")
    channels = table(spark, sf, "customer").select(
        F.col("c_name").alias("source_id"),
        F.col("c_name").alias("channel_name"),
        F.col("c_mktsegment").alias("discovery_source"),
        F.lit("v1").alias("discovery_source_version"),
    )
    tables = frame_tables(channels, frame, "VIDEO", EVENT_1.occurred_at)
    return (
        tables["frame_channel"]
        .join(tables["channel"], "channel_key")
        .join(tables["source_observation"], "frame_channel_key")
        .select("channel_key", "source_id", "frame_inclusion_status", "frame_channel_key", "discovery_source")
    )
