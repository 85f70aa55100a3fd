"""Versioning, deduplication and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions.times import ntz
from eventlens.operators import history
from eventlens.operators.cohort import append_provenance
from eventlens.operators.joins import insert_if_absent
from eventlens.plans.catalog.base import cte, query, table
from eventlens.plans.catalog.joins import _VERSIONS

UUID = r"regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


@query(
    "t1_scd2_merge",
    """WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE upper(c_mktsegment) END AS segment
        FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 10000000, c_mktsegment FROM customer),
      live AS (SELECT c_custkey, c_mktsegment AS segment FROM customer),
      j AS (SELECT coalesce(l.c_custkey, i.c_custkey) AS k, l.segment AS old, i.segment AS new,
        i.c_custkey IS NOT NULL AND (l.c_custkey IS NULL OR lower(l.segment) <> lower(i.segment)) AS changed
        FROM live l FULL JOIN i USING (c_custkey))
    SELECT c_custkey, 'OLDER' AS segment, timestamp '2019-01-01' AS valid_from, timestamp '2020-01-01' AS valid_to, FALSE AS is_current FROM customer
    UNION ALL SELECT k, old, timestamp '2020-01-01', CASE WHEN changed THEN timestamp '2024-01-01' END, NOT changed FROM j WHERE old IS NOT NULL
    UNION ALL SELECT k, new, timestamp '2024-01-01', NULL, TRUE FROM j WHERE changed""",
)
def _t1(spark, sf):
    stored, incoming = segment_versions(spark, sf)
    out = history.scd2_merge(stored, incoming, ["c_custkey"], ["terms"], ntz("2024-01-01 00:00:00"), term_lists=["terms"])
    return out.withColumn("segment", F.get("terms", F.lit(0))).drop("terms")


def segment_versions(spark, sf):
    """Segments as one-element term lists, so a change of case alone keeps the version; and the incoming ones."""
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    none = F.lit(None).cast("timestamp_ntz")
    live = customers.select(
        "c_custkey",
        F.array("segment").alias("terms"),
        ntz("2020-01-01 00:00:00").alias("valid_from"),
        none.alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    older = customers.select(
        "c_custkey",
        F.array(F.lit("OLDER")).alias("terms"),
        ntz("2019-01-01 00:00:00").alias("valid_from"),
        ntz("2020-01-01 00:00:00").alias("valid_to"),
        F.lit(False).alias("is_current"),
    )
    k = F.col("c_custkey")
    changed = customers.filter(k % 5 != 0).select(
        k, F.array(F.when(k % 3 == 0, F.lit("CHANGED")).otherwise(F.upper("segment"))).alias("terms")
    )
    added = customers.select((k + 10000000).alias("c_custkey"), F.array("segment").alias("terms"))
    return live.unionByName(older), changed.unionByName(added)


@query(
    "t2_scd2_from_history",
    f"""SELECT o_custkey, status AS o_orderstatus, valid_from, valid_to, valid_to IS NULL AS is_current FROM ({_VERSIONS})""",
)
def _t2(spark, sf):
    return history.scd2_from_history(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")


@query(
    "t3_insert_if_absent",
    f"""WITH s AS (SELECT DISTINCT source FROM documents),
      known AS (SELECT source AS source_id, 'known' AS origin FROM s WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0)
    SELECT {UUID.format("source_id")} AS channel_key, source_id, origin FROM (
      SELECT * FROM known UNION ALL SELECT DISTINCT source, 'new' FROM documents WHERE source NOT IN (SELECT source_id FROM known))""",
)
def _t3(spark, sf):
    from eventlens.functions.keys import md5_uuid

    sources = table(spark, sf, "documents").select(F.col("source").alias("source_id"))
    keyed = sources.select(md5_uuid(F.col("source_id")).alias("channel_key"), "source_id")
    even = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int") % 2 == 0
    known = keyed.filter(even).distinct().withColumn("origin", F.lit("known"))
    return insert_if_absent(known, keyed.withColumn("origin", F.lit("new")), ["channel_key"])


@query(
    "t4_merge_update_insert",
    """SELECT coalesce(p.p_partkey, l.k) AS p_partkey, CASE WHEN l.k IS NULL THEN p.p_name ELSE 'sold' END AS label,
      CASE WHEN l.k IS NULL THEN p.p_retailprice ELSE l.price END AS price
    FROM part p FULL JOIN (SELECT l_partkey * 2 AS k, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL) l ON p.p_partkey = l.k""",
)
def _t4(spark, sf):
    from eventlens.operators.joins import upsert

    return upsert(*part_prices(spark, sf), ["p_partkey"], ["label", "price"])


def part_prices(spark, sf):
    """Parts, and the sold ones with a new label and price, under twice their number."""
    current = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_retailprice").alias("price"))
    changes = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_partkey") * 2).alias("p_partkey"))
        .agg(F.max("l_extendedprice").alias("price"))
        .withColumn("label", F.lit("sold"))
    )
    return current, changes


@query(
    "t5_freeze_once",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE n_chars + 1 END AS duration_seconds,
      CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE CASE doc_id % 7 WHEN 0 THEN TRUE END END AS is_short,
      CASE WHEN doc_id % 5 < 2 THEN 'old' WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS short_classification_rule_version,
      CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'xx' END AS primary_language_code,
      timestamp '2024-01-01 00:00:00' AS published_at FROM documents""",
)
def _t5(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    stored = docs.select(
        "doc_id",
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.when(d % 4 == 0, F.col("n_chars")).alias("duration_seconds"),
        F.when(d % 5 == 0, True).when(d % 5 == 1, False).alias("is_short"),
        F.lit("old").alias("short_classification_rule_version"),
        F.when(d % 3 == 0, F.col("lang")).when(d % 3 == 1, F.lit("UNKNOWN")).alias("primary_language_code"),
    )
    refreshed = docs.select(
        "doc_id",
        ntz("2024-01-01 00:00:00").alias("published_at"),
        (F.col("n_chars") + 1).alias("duration_seconds"),
        F.when(d % 7 == 0, True).alias("is_short"),
        F.lit("new").alias("short_classification_rule_version"),
        F.lit("xx").alias("primary_language_code"),
    )
    return history.freeze_once(stored, refreshed, ["doc_id"])


# Every event observed in two runs a day apart; the second run sees edits and more likes.
cte(
    "observations",
    f"""SELECT 'c' || event_id AS source_comment_id, event_id, r AS run, ts AS published_at,
      ts + to_days(r) AS observed_at, event_id % 3 AS page_number, event_id AS item_position,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_key,
      CASE WHEN user_id % 10 <> 0 THEN user_id END AS author_key,
      event_type || CASE WHEN r = 2 AND event_id % 5 = 0 THEN ' edited' ELSE '' END AS text_content,
      CAST(floor(value) AS BIGINT) + CASE WHEN r = 2 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS likes,
      event_id % 4 AS reply_count, 'run' || r AS ingestion_run_id, {UUID.format("'p' || r || ':' || event_id")} AS raw_response_id,
      CASE WHEN event_id % 19 = 0 THEN 'RELEVANCE' ELSE 'CHRONOLOGICAL' END AS sample_type
    FROM events, (VALUES (1), (2)) v(r)""",
)


def observations(spark, sf):
    from eventlens.functions.keys import md5_uuid

    e, r = F.col("event_id"), F.col("run")
    rows = table(spark, sf, "events").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    edited = (r == 2) & (e % 5 == 0)
    return rows.select(
        F.concat(F.lit("c"), e.cast("string")).alias("source_comment_id"),
        "event_id",
        "run",
        F.col("ts").alias("published_at"),
        (F.col("ts") + F.make_dt_interval(r)).alias("observed_at"),
        (e % 3).alias("page_number"),
        e.alias("item_position"),
        F.get_json_object("props", "$.k").cast("bigint").alias("video_key"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("author_key"),
        F.concat("event_type", F.when(edited, F.lit(" edited")).otherwise(F.lit(""))).alias("text_content"),
        (F.floor("value").cast("bigint") + F.when((r == 2) & (e % 3 == 0), 1).otherwise(0)).alias("likes"),
        (e % 4).alias("reply_count"),
        F.concat(F.lit("run"), r.cast("string")).alias("ingestion_run_id"),
        md5_uuid(F.concat(F.lit("p"), r.cast("string")), e).alias("raw_response_id"),
        F.when(e % 19 == 0, F.lit("RELEVANCE")).otherwise(F.lit("CHRONOLOGICAL")).alias("sample_type"),
    )


@query(
    "t6_canonical_comments",
    f"""SELECT {UUID.format("source_comment_id")} AS comment_key, source_comment_id, any_value(video_key) AS video_key,
      any_value(author_key) AS author_key, min(published_at) AS published_at, min(observed_at) AS first_observed_at,
      count(*) - 1 AS duplicate_observations FROM observations GROUP BY source_comment_id""",
    "observations",
)
def _t6(spark, sf):
    return history.canonical_comments(observations(spark, sf))


@query(
    "t7_text_versions",
    """SELECT source_comment_id, sha256(text_content) AS text_hash, min(observed_at) AS observed_at,
      max(run) = 2 AS is_latest_version FROM observations GROUP BY source_comment_id, text_content""",
    "observations",
)
def _t7(spark, sf):
    return history.text_versions(observations(spark, sf))


@query(
    "t8_change_only_engagement",
    """SELECT source_comment_id, observed_at, likes, reply_count FROM observations WHERE run = 1 OR event_id % 3 = 0""",
    "observations",
)
def _t8(spark, sf):
    rows = observations(spark, sf).select("source_comment_id", "observed_at", "likes", "reply_count")
    return history.change_only(rows, "source_comment_id", ["observed_at"], ["likes", "reply_count"])


@query(
    "t8_change_only_by_video",
    """SELECT video_key, event_id, flag FROM (SELECT video_key, event_id, event_id % 7 < 3 AS flag,
      lag(event_id % 7 < 3) OVER (PARTITION BY video_key ORDER BY observed_at, event_id) AS prev FROM observations)
    WHERE prev IS DISTINCT FROM flag""",
    "observations",
)
def _t8_video(spark, sf):
    """The same operator with long groups: a state per video over all observations of its comments."""
    rows = observations(spark, sf).select("video_key", "event_id", "observed_at", (F.col("event_id") % 7 < 3).alias("flag"))
    return history.change_only(rows, "video_key", ["observed_at", "event_id"], ["flag"]).drop("observed_at")


@query(
    "t9_sample_observations",
    f"""SELECT {UUID.format("source_comment_id")} AS comment_key, raw_response_id, item_position AS source_item_position,
      sample_type, observed_at FROM observations""",
    "observations",
)
def _t9(spark, sf):
    return history.sample_observations(observations(spark, sf))


@query(
    "t15_provenance_append",
    """SELECT event_id AS video_event_key, CAST(q AS VARCHAR) AS query_hash, k % 20 AS channel_key,
      CASE WHEN q = k % 4 THEN 'run1' ELSE 'run2' END AS unit_status
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), range(4) t(q)
    WHERE q = k % 4 OR q = event_id % 4""",
)
def _t15(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = table(spark, sf, "events").select("event_id", k.alias("k"))

    def entries(query_hash, status):
        return base.select(
            F.col("event_id").alias("video_event_key"),
            F.lit("f0").alias("frame_version_key"),
            (F.col("k") % 20).alias("channel_key"),
            F.lit("w0").alias("window_key"),
            F.lit("1.0").alias("discovery_policy_version"),
            query_hash.cast("string").alias("query_hash"),
            F.lit(status).alias("unit_status"),
        )

    old, new = entries(F.col("k") % 4, "run1"), entries(F.col("event_id") % 4, "run2")
    return append_provenance(old, new).select("video_event_key", "query_hash", "channel_key", "unit_status")


_ATTEMPT_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'RETRYABLE_ERROR' ELSE 'PARSE_ERROR' END"


@query(
    "t17_resolution_state",
    f"""WITH a AS (SELECT o_custkey AS source_id, o_orderdate AS t, o_orderkey AS id, {_ATTEMPT_STATUS} AS status,
        CASE WHEN o_orderstatus <> 'F' THEN 'E' || o_orderpriority END AS err, o_orderkey % 3 AS retries FROM orders)
    SELECT source_id, arg_max(status, (t, id)) AS resolution_status, min(t) AS first_discovered_at,
      max(t) FILTER (status = 'RESOLVED') AS resolved_at, max(t) AS updated_at,
      CASE WHEN arg_max(status, (t, id)) <> 'RESOLVED' THEN arg_max(err, (t, id)) END AS last_error_code,
      CAST(sum(retries) AS BIGINT) AS retry_count FROM a GROUP BY source_id""",
)
def _t17(spark, sf):
    return history.resolution_state(video_attempts(spark, sf))


def video_attempts(spark, sf):
    """Orders as attempts to resolve their customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderdate").alias("attempted_at"),
        F.col("o_orderkey").alias("attempt_id"),
        F.when(F.col("o_orderstatus") == "F", "RESOLVED")
        .when(F.col("o_orderstatus") == "O", "RETRYABLE_ERROR")
        .otherwise("PARSE_ERROR")
        .alias("status"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("E"), "o_orderpriority")).alias("error_code"),
        (F.col("o_orderkey") % 3).alias("retry_count"),
    )


def unit_attempts(spark, sf):
    """Orders as attempts on discovery units: one unit per customer and priority."""
    o = table(spark, sf, "orders")
    return o.select(
        F.lit("f0").alias("frame_version_key"),
        F.col("o_custkey").alias("channel_key"),
        F.lit("w0").alias("window_key"),
        F.lit("1.0").alias("discovery_policy_version"),
        F.col("o_orderpriority").alias("query_hash"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PARTIAL").alias("status"),
        F.when(F.col("o_orderstatus") != "F", F.lit("HTTP_429")).alias("error_code"),
        (F.col("o_orderkey") % 7).alias("pages_completed"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("updated_at"),
        F.col("o_orderkey").alias("attempt_id"),
    )


@query(
    "t18_unit_state",
    """WITH a AS (SELECT *, o_orderdate + to_hours(1) AS u FROM orders)
    SELECT o_custkey AS channel_key, o_orderpriority AS query_hash, min(o_orderdate) AS started_at, max(u) AS updated_at,
      CASE WHEN arg_max(o_orderstatus, (u, o_orderkey)) = 'F' THEN 'COMPLETED' ELSE 'PARTIAL' END AS status,
      arg_max(o_orderkey, (u, o_orderkey)) % 7 AS pages_completed,
      CASE WHEN arg_max(o_orderstatus, (u, o_orderkey)) = 'F' THEN max(u) END AS completed_at,
      CASE WHEN arg_max(o_orderstatus, (u, o_orderkey)) <> 'F' THEN 'HTTP_429' END AS last_error_code
    FROM a GROUP BY ALL""",
)
def _t18(spark, sf):
    return history.unit_state(unit_attempts(spark, sf)).select(
        "channel_key", "query_hash", "started_at", "updated_at", "status", "pages_completed", "completed_at", "last_error_code"
    )
