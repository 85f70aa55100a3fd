"""Scalar functions and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions import keys, text, times
from eventlens.operators.cohort import discovery_eligibility, video_eligibility
from eventlens.operators.windows import date_dimension, in_windows, time_dimension
from eventlens.plans.catalog.base import (
    ALIASES_A,
    ALIASES_B,
    ALL_ALIASES,
    EVENT_1,
    EVENT_2,
    NEGATIVE_BELOW,
    POSITIVE_ABOVE,
    RELEVANCE_TEXT,
    comments,
    documents,
    mentions_sql,
    query,
    table,
    videos,
)

PLAYERS, EVENT_TERMS, BASELINE_TERMS = ALL_ALIASES, EVENT_1.event_terms, EVENT_1.baseline_terms


@query(
    "p1_phrase_match",
    f"""SELECT doc_id, {mentions_sql('text', ALIASES_A)} AS mentions_a, {mentions_sql('text', ALIASES_B)} AS mentions_b
    FROM documents""",
)
def _p1(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        text.mentions_any(F.col("text"), ALIASES_A).alias("mentions_a"),
        text.mentions_any(F.col("text"), ALIASES_B).alias("mentions_b"),
    )


_HITS = ", ".join(
    f"CASE WHEN {mentions_sql('text', [a])} THEN '{a.lower()}' END" for a in sorted(x.lower() for x in ALL_ALIASES)
)


@query("p2_matched_aliases", f"SELECT doc_id, concat_ws(',', {_HITS}) AS matched FROM documents")
def _p2(spark, sf):
    hits = text.matched_terms(F.col("text"), ALL_ALIASES)
    return documents(spark, sf).select("doc_id", F.array_join(hits, ",").alias("matched"))


_DURATION_TEXT = """CASE doc_id % 7 WHEN 0 THEN 'PT' || (n_chars % 60) || 'S' WHEN 1 THEN 'PT' || (n_chars % 99) || 'M15S'
  WHEN 2 THEN 'PT1H2M' || (n_chars % 60) || 'S' WHEN 3 THEN 'P' || (n_chars % 4) || 'D' WHEN 4 THEN '' WHEN 5 THEN NULL
  ELSE 'INVALID' || n_chars END"""


@query(
    "p3_duration_seconds",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN n_chars % 60 WHEN 1 THEN (n_chars % 99) * 60 + 15
      WHEN 2 THEN 3720 + n_chars % 60 WHEN 3 THEN (n_chars % 4) * 86400 ELSE 0 END AS duration_seconds FROM documents""",
)
def _p3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_DURATION_TEXT).alias("d"))
    return docs.select("doc_id", times.duration_seconds(F.col("d")).alias("duration_seconds"))


@query(
    "p4_naive_utc",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts - to_hours(3)
      WHEN 3 THEN ts + to_hours(5) ELSE NULL END AS utc FROM events""",
)
def _p4(spark, sf):
    """The same wall clock written with Z, +00:00, +03:00, -05:00, and an unreadable text."""
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = F.col("event_id") % 5
    suffix = F.when(e == 0, "Z").when(e == 1, "+00:00").when(e == 2, "+03:00").when(e == 3, "-05:00")
    written = F.when(e == 4, F.concat(F.lit("about "), wall)).otherwise(F.concat(wall, suffix))
    return table(spark, sf, "events").select("event_id", times.utc_ntz(written).alias("utc"))


@query(
    "p5_canonical_terms",
    r"""SELECT conv_id, turn, array_to_string(list_sort(list_transform(string_split(text, ' '),
      lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g')))), ' ') AS terms FROM conversations""",
)
def _p5(spark, sf):
    terms = text.canonical_terms(F.split("text", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"))


@query(
    "p6_language_code",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(lang) || '-extended-lang' WHEN doc_id % 3 = 1 THEN lang
      ELSE 'UNKNOWN' END AS language_code FROM documents""",
)
def _p6(spark, sf):
    d = F.col("doc_id") % 3
    audio = F.when(d == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("-EXTENDED-LANGUAGE-TAG ")))
    default = F.when(d != 2, F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id", text.language_code(audio, default).alias("language_code")
    )


@query("p7_sha256", "SELECT page_id, sha256(html) AS payload_hash FROM pages")
def _p7(spark, sf):
    return table(spark, sf, "pages").select("page_id", keys.sha256(F.col("html")).alias("payload_hash"))


SECRETS = {"salt1": b"fixture-secret-one", "salt2": b"fixture-secret-two-" * 5}


def _pad_sql(version: str, byte: int) -> str:
    import hashlib

    secret = SECRETS[version]
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    return "'" + "".join(f"\\x{b ^ byte:02x}" for b in key.ljust(64, b"\0")) + "'::BLOB"


def _hmac_sql(version: str) -> str:
    inner = f"sha256({_pad_sql(version, 0x36)} || encode(author))"
    return f"sha256({_pad_sql(version, 0x5C)} || unhex({inner}))"


@query(
    "p8_author_pseudonym",
    f"""SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'salt1' ELSE 'salt2' END AS salt_version_id,
      CASE event_id % 2 WHEN 0 THEN {_hmac_sql('salt1')} ELSE {_hmac_sql('salt2')} END AS author_hash
    FROM (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS author FROM events)""",
)
def _p8(spark, sf):
    authors = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("author"),
        F.when(F.col("event_id") % 2 == 0, "salt1").otherwise("salt2").alias("salt_version_id"),
    )
    return keys.pseudonymise(authors, "author", SECRETS).drop("author")


_UUID = r"regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


@query(
    "p9_md5_uuid",
    f"SELECT o_orderkey, {_UUID.format('o_custkey || chr(58) || o_orderstatus')} AS version_key FROM orders",
)
def _p9(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", keys.md5_uuid(F.col("o_custkey"), F.col("o_orderstatus")).alias("version_key")
    )


@query(
    "p10_provenance_predicate",
    """SELECT event_id, k % 3 = 0 OR (k + 1) % 3 = 0 AS through_frame, k % 3 = 0 AND event_id % 2 = 0 AS exact_entry
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def _p10(spark, sf):
    """Provenance arrays with two discovery queries; which records came through frame 0?"""
    k = F.get_json_object("props", "$.k").cast("bigint")

    def entry(frame, query_hash):
        return F.struct(frame.cast("string").alias("frame_version_key"), query_hash.alias("query_hash"))

    parity = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    rows = table(spark, sf, "events").select(
        "event_id", F.array(entry(k % 3, parity), entry((k + 1) % 3, F.lit("late"))).alias("queries")
    )
    return rows.select(
        "event_id",
        F.exists("queries", lambda q: q["frame_version_key"] == "0").alias("through_frame"),
        F.exists("queries", lambda q: (q["frame_version_key"] == "0") & (q["query_hash"] == "even")).alias("exact_entry"),
    )


@query(
    "p12_proximity",
    """SELECT event_id, date_diff('microsecond', timestamp '2024-01-15 12:00:00', ts) / 1000000.0::DOUBLE AS delta_seconds,
      abs(date_diff('microsecond', timestamp '2024-01-15 12:00:00', ts)) / 1000000.0::DOUBLE AS proximity_seconds FROM events""",
)
def _p12(spark, sf):
    delta = times.seconds_between(times.ntz(str(EVENT_1.occurred_at)), F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", delta.alias("delta_seconds"), F.abs(delta).alias("proximity_seconds")
    )


ELIGIBILITY_CTE = f"""
  f AS (SELECT *, date_diff('microsecond', timestamp '2024-01-15 12:00:00', published_at) AS d,
      {mentions_sql(RELEVANCE_TEXT, PLAYERS)} AS pl, {mentions_sql(RELEVANCE_TEXT, EVENT_TERMS)} AS ev,
      {mentions_sql(RELEVANCE_TEXT, [*PLAYERS, *BASELINE_TERMS])} AS bl FROM videos),
  g AS (SELECT *, CASE WHEN resolution_status = 'UNAVAILABLE' THEN 'VIDEO_UNAVAILABLE'
      WHEN resolution_status IS DISTINCT FROM 'RESOLVED' THEN 'METADATA_UNRESOLVED'
      WHEN is_short THEN 'YOUTUBE_SHORT' WHEN is_short IS NULL THEN 'SHORTS_UNRESOLVED'
      WHEN primary_language_code <> 'UNKNOWN' AND NOT starts_with(primary_language_code, 'en') THEN 'NON_ENGLISH_METADATA'
      END AS early FROM f),
  eligibility AS (SELECT * EXCLUDE (f_cohort, f_reason), f_cohort AS cohort_type, f_reason AS reason,
      f_reason IS NULL AS is_eligible, CASE WHEN early IS NULL THEN abs(d) / 1000000.0::DOUBLE END AS proximity_seconds,
      early IS NULL AND ev AS event_matched, early IS NULL AND pl AS player_matched
    FROM (SELECT *, CASE WHEN early IS NOT NULL OR d < -1209600000000 OR d > 259200000000 THEN NULL
        WHEN d < -86400000000 THEN 'BASELINE'
        WHEN d <= -3600000000 THEN CASE WHEN ev THEN 'EVENT' WHEN bl THEN 'BASELINE' END ELSE 'EVENT' END AS f_cohort,
      CASE WHEN early IS NOT NULL THEN early WHEN d < -1209600000000 OR d > 259200000000 THEN 'OUT_OF_WINDOW'
        WHEN d < -86400000000 THEN CASE WHEN NOT bl THEN 'NO_TARGET_RELEVANCE' END
        WHEN d <= -3600000000 THEN CASE WHEN NOT ev AND NOT bl THEN 'NO_TARGET_RELEVANCE' END
        WHEN NOT ev THEN 'NO_TARGET_RELEVANCE' END AS f_reason FROM g))"""


@query(
    "p13_video_eligibility",
    f"""WITH {ELIGIBILITY_CTE}
    SELECT video_key, is_eligible, cohort_type, reason, proximity_seconds, event_matched, player_matched FROM eligibility""",
    "videos",
)
def _p13(spark, sf):
    return video_eligibility(videos(spark, sf), EVENT_1, PLAYERS).select(
        "video_key", "is_eligible", "cohort_type", "reason", "proximity_seconds", "event_matched", "player_matched"
    )


def _discovery_sql(e) -> str:
    start, end = e.windows[0].start_hours, e.windows[-1].end_hours
    inside = (
        f"published_at BETWEEN timestamp '{e.occurred_at}' + to_hours({start}) "
        f"AND timestamp '{e.occurred_at}' + to_hours({end})"
    )
    relevant = mentions_sql(RELEVANCE_TEXT, [*PLAYERS, *e.event_terms])
    return f"""SELECT video_key, '{e.event_key}' AS event_version_key,
      CASE WHEN {inside} AND {relevant} THEN 'ELIGIBLE' ELSE 'INELIGIBLE' END AS inclusion_status,
      CASE WHEN NOT {inside} THEN 'OUT_OF_WINDOW' WHEN NOT {relevant} THEN 'NO_TARGET_RELEVANCE' END
        AS primary_exclusion_reason FROM videos"""


@query("p14_discovery_eligibility", f"{_discovery_sql(EVENT_1)} UNION ALL {_discovery_sql(EVENT_2)}", "videos")
def _p14(spark, sf):
    out = discovery_eligibility(videos(spark, sf), [EVENT_1, EVENT_2], PLAYERS)
    return out.select("video_key", "event_version_key", "inclusion_status", "primary_exclusion_reason")


@query(
    "p16_exclusion_reason",
    """SELECT page_id, CASE WHEN trim(html) = '' THEN 'EMPTY_TEXT'
      WHEN len(regexp_extract_all(lower(html), 'https?://|www\\.')) >= 2 THEN 'LINK_SOLICITATION' END AS exclusion_reason,
      'spam_v1' AS spam_rule_version
    FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN repeat(' ', 3) ELSE html || url || url END AS html FROM pages)""",
)
def _p16(spark, sf):
    page = F.when(F.col("page_id") % 10 == 0, F.lit("   ")).otherwise(F.concat("html", "url", "url"))
    return table(spark, sf, "pages").select(
        "page_id",
        text.exclusion_reason(page, 2).alias("exclusion_reason"),
        F.lit("spam_v1").alias("spam_rule_version"),
    )


@query(
    "p17_valence_band",
    f"""SELECT comment_key, CASE WHEN valence < {NEGATIVE_BELOW} THEN 'NEGATIVE' WHEN valence > {POSITIVE_ABOVE}
      THEN 'POSITIVE' ELSE 'NEUTRAL' END AS band FROM comments""",
    "comments",
)
def _p17(spark, sf):
    band = text.valence_band(F.col("valence"), NEGATIVE_BELOW, POSITIVE_ABOVE)
    return comments(spark, sf).select("comment_key", band.alias("band"))


@query(
    "p18_stored_text",
    """SELECT doc_id, substr(text, 1, 4900) AS description, length(substr(text, 1, 4900)) AS stored_length,
      substr(text, 1, 100) AS preview FROM documents""",
)
def _p18(spark, sf):
    stored = text.stored_description(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id",
        stored.alias("description"),
        F.char_length(stored).cast("bigint").alias("stored_length"),
        F.substring("text", 1, 100).alias("preview"),
    )


@query(
    "p19_date_dimension",
    """SELECT CAST(d AS DATE) AS date_key, CAST(dayofweek(d) + 1 AS BIGINT) AS day_of_week, month(d) AS month, year(d) AS year
    FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM events)""",
)
def _p19(spark, sf):
    return date_dimension(table(spark, sf, "events"), "ts")


@query(
    "p19_time_dimension",
    """SELECT DISTINCT strftime(ts, '%H:%M:%S') AS time_key, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second
    FROM events""",
)
def _p19_time(spark, sf):
    return time_dimension(table(spark, sf, "events"), "ts")


@query(
    "p20_evidence_spans",
    """SELECT conv_id, turn, s, e, s >= 0 AND e <= length(text) AND s < e AS is_inside
    FROM (SELECT conv_id, turn, text, turn * 20 - 5 AS s, conv_id % 200 AS e FROM conversations)""",
)
def _p20(spark, sf):
    spans = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("turn") * 20 - 5).alias("s"), (F.col("conv_id") % 200).alias("e")
    )
    inside = text.span_is_inside(F.col("s"), F.col("e"), F.col("text"))
    return spans.select("conv_id", "turn", "s", "e", inside.alias("is_inside"))


@query(
    "p11_window_bounds",
    """SELECT w.event_version_key, w.window_type, start_at AS absolute_start_at, end_at AS absolute_end_at,
      count(c.comment_key) AS comment_count
    FROM windows2 w JOIN comments c ON c.published_at >= start_at AND c.published_at < end_at GROUP BY ALL""",
    "windows2 comments",
)
def _p11(spark, sf):
    from eventlens.operators.windows import window_table

    bounds = window_table(spark, [EVENT_1, EVENT_2]).select(
        "event_version_key", "window_type", "absolute_start_at", "absolute_end_at"
    )
    counts = (
        in_windows(comments(spark, sf).select("comment_key", "published_at"), [EVENT_1, EVENT_2])
        .groupBy("event_version_key", "window_type")
        .agg(F.count(F.lit(1)).alias("comment_count"))
    )
    return bounds.join(counts, ["event_version_key", "window_type"])


