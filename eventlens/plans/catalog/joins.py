"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import cohort, joins
from eventlens.operators.ordered import latest_per_key
from eventlens.operators.strata import strata_seed
from eventlens.operators.windows import assign_windows, window_table
from eventlens.plans.catalog.base import (
    ENTITIES,
    EVENT_1,
    EVENT_2,
    comments,
    cte,
    documents,
    mentions_sql,
    query,
    table,
    videos,
)
from eventlens.sources.reference_data import alias_rows


@query(
    "j1_window_range_join",
    """SELECT comment_key, event_version_key, window_type FROM comments
    JOIN windows2 ON published_at >= start_at AND published_at < end_at""",
    "comments windows2",
)
def _j1(spark, sf):
    facts = comments(spark, sf).select("comment_key", "published_at")
    return assign_windows(facts, window_table(spark, [EVENT_1, EVENT_2])).select(
        "comment_key", "event_version_key", "window_type"
    )


# links, frames, state and snapshots derived from documents; two events per video
cte(
    "links",
    """SELECT video_key, e AS event_version_key, video_key || ':' || e AS video_event_key, video_key % 3 AS frame,
      video_key % 5 = 0 AS whole_record FROM videos, (VALUES ('EV1'), ('EV2')) t(e)""",
    "videos",
)


def _links(spark, sf):
    """Two links per video; the frame sits in a discovery query or on the whole record."""
    v = F.col("video_key")
    frame = (v % 3).cast("string")
    whole = v % 5 == 0
    provenance = F.struct(
        F.when(whole, frame).alias("frame_version_key"),
        F.when(~whole, F.array(F.struct(frame.alias("frame_version_key"), F.lit("q").alias("query_hash")))).alias("queries"),
    )
    return (
        videos(spark, sf)
        .select("video_key", "source_id", provenance.alias("discovery_provenance"))
        .withColumn("event_version_key", F.explode(F.array(F.lit("EV1"), F.lit("EV2"))))
        .withColumn("video_event_key", F.concat_ws(":", v.cast("string"), "event_version_key"))
    )


def _snapshots(spark, sf):
    """Two snapshots per video, the later one with an edited title."""
    v = videos(spark, sf)
    cols = ["video_key", "description"]
    first = v.select(*cols, "title", F.col("published_at").alias("observed_at"), F.lit("s1").alias("video_snapshot_key"))
    second = v.select(
        *cols,
        F.concat(F.lit("edited "), "title").alias("title"),
        (F.col("published_at") + F.make_dt_interval(F.lit(1))).alias("observed_at"),
        F.lit("s2").alias("video_snapshot_key"),
    )
    return first.unionByName(second)


def _frame_channels(spark, sf):
    channel = F.regexp_extract("channel_key", r"(\d+)$", 1).cast("int")
    return (
        videos(spark, sf)
        .select("channel_key")
        .distinct()
        .select(
            "channel_key",
            F.lit("0").alias("frame_version_key"),
            F.when(channel % 4 == 0, F.lit("EXCLUDED")).otherwise(F.lit("ELIGIBLE")).alias("frame_inclusion_status"),
        )
    )


@query(
    "j2_candidate_videos",
    """SELECT v.video_key, event_version_key, video_event_key, resolution_status, 'edited ' || title AS title,
      length(description) AS description_length
    FROM videos v JOIN links USING (video_key)
    WHERE frame = 0 AND CAST(regexp_extract(channel_key, '(\\d+)$', 1) AS INT) % 4 <> 0""",
    "videos links",
)
def _j2(spark, sf):
    v = videos(spark, sf)
    state = v.select("source_id", "video_key", "resolution_status")
    # one state row per source id: copies of a video share it only when they agree on the video
    resolution = state.select(F.concat_ws("/", "source_id", F.col("video_key").cast("string")).alias("source_id"), "resolution_status")
    base = v.select("video_key", "channel_key", "published_at", F.concat_ws("/", "source_id", F.col("video_key").cast("string")).alias("source_id"))
    out = joins.candidate_videos(
        base, _links(spark, sf), _frame_channels(spark, sf), resolution, _snapshots(spark, sf), "0"
    )
    return out.select(
        "video_key",
        "event_version_key",
        "video_event_key",
        "resolution_status",
        "title",
        F.char_length("description").cast("bigint").alias("description_length"),
    )


_ALIAS_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{e.entity_key}' AS target_entity_key, '{a.lower()}' AS alias_text FROM documents "
    f"WHERE {mentions_sql('text', [a])}"
    for e in ENTITIES
    for a in e.aliases
)


@query("j3_alias_theta_join", _ALIAS_ROWS)
def _j3(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return joins.alias_matches(docs, alias_rows(spark, ENTITIES), "doc_id").select("doc_id", "target_entity_key", "alias_text")


@query(
    "j4_scoped_aliases",
    """SELECT event_version_key, target_entity_key, alias_text FROM
      (SELECT DISTINCT 'E' || o_orderpriority AS event_version_key, 'C' || o_custkey AS target_entity_key, o_custkey FROM orders)
      JOIN (SELECT c_custkey, lower(c_name) AS alias_text FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""",
)
def _j4(spark, sf):
    entity = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    aliases = table(spark, sf, "customer").select(
        entity.alias("target_entity_key"), F.lower("c_name").alias("alias_text"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    roles = table(spark, sf, "orders").select(
        F.concat(F.lit("E"), "o_orderpriority").alias("event_version_key"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("target_entity_key"),
    )
    return joins.scoped_aliases(aliases, roles).select("event_version_key", "target_entity_key", "alias_text")


@query(
    "j5_semi_join_provenance",
    """SELECT video_event_key FROM links WHERE frame = 1 AND NOT whole_record""",
    "links",
)
def _j5(spark, sf):
    links = _links(spark, sf)
    entries = links.select("video_event_key", F.explode("discovery_provenance.queries").alias("q"))
    through = entries.filter(F.col("q.frame_version_key") == "1").select("video_event_key")
    return links.select("video_event_key").join(through, "video_event_key", "left_semi")


@query(
    "j9_upsert",
    """SELECT coalesce(c.c_custkey, o.k) AS c_custkey, CASE WHEN o.k IS NULL THEN c.c_mktsegment ELSE 'ACTIVE' END AS segment,
      CASE WHEN o.k IS NULL THEN c.c_acctbal ELSE o.total END AS balance
    FROM customer c FULL JOIN (SELECT o_custkey * 2 AS k, max(o_totalprice) AS total FROM orders GROUP BY ALL) o ON c.c_custkey = o.k""",
)
def _j9(spark, sf):
    return joins.upsert(*customer_balances(spark, sf), ["c_custkey"], ["segment", "balance"])


def customer_balances(spark, sf):
    """Customers, and new balances of those with twice an order's customer number, some of them unknown."""
    current = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    changes = (
        table(spark, sf, "orders")
        .groupBy((F.col("o_custkey") * 2).alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("balance"))
        .withColumn("segment", F.lit("ACTIVE"))
    )
    return current, changes


cte(
    "pinned",
    """SELECT channel_key, CASE WHEN n % 4 = 1 THEN 'CLUB_MEDIA' ELSE 'INDEPENDENT_CREATOR' END AS channel_type_value,
      CASE WHEN n % 2 = 0 THEN 'A_FOCUSED' ELSE 'B_FOCUSED' END AS focus_value
    FROM (SELECT DISTINCT channel_key, CAST(regexp_extract(channel_key, '(\\d+)$', 1) AS INT) AS n FROM videos) WHERE n % 5 <> 0""",
    "videos",
)


def pinned_snapshots(spark, sf, keep_all=False):
    n = F.regexp_extract("channel_key", r"(\d+)$", 1).cast("int")
    rows = videos(spark, sf).select("channel_key").distinct()
    rows = rows if keep_all else rows.filter(n % 5 != 0)
    return rows.select(
        "channel_key",
        F.lit("EV1").alias("event_version_key"),
        F.when(n % 4 == 1, F.lit("CLUB_MEDIA")).otherwise(F.lit("INDEPENDENT_CREATOR")).alias("channel_type_value"),
        F.when(n % 2 == 0, F.lit("A_FOCUSED")).otherwise(F.lit("B_FOCUSED")).alias("focus_value"),
    )


@query(
    "j8_snapshot_gate",
    """SELECT channel_key, count(*) AS video_count FROM videos
    WHERE NOT EXISTS (SELECT 1 FROM pinned p WHERE p.channel_key = videos.channel_key) GROUP BY ALL""",
    "videos pinned",
)
def _j8(spark, sf):
    """What the gate stops for: channels without a pinned stratum, and how many videos wait for it."""
    waiting = joins.missing_from(videos(spark, sf).select("channel_key"), pinned_snapshots(spark, sf), ["channel_key"])
    return waiting.groupBy("channel_key").agg(F.count(F.lit(1)).alias("video_count"))


@query(
    "j10_stratum_label",
    """SELECT coalesce(channel_type_value || ' x ' || focus_value, 'UNCLASSIFIED') AS stratum_name, count(*) AS videos
    FROM videos LEFT JOIN pinned USING (channel_key) GROUP BY ALL""",
    "videos pinned",
)
def _j10(spark, sf):
    rows = videos(spark, sf).select("video_key", "channel_key")
    snapshots = pinned_snapshots(spark, sf).drop("event_version_key")
    return joins.stratum_label(rows, snapshots, ["channel_key"]).groupBy("stratum_name").agg(
        F.count(F.lit(1)).alias("videos")
    )


@query(
    "j11_lineage_trace",
    """SELECT l_orderkey AS video_key, CASE WHEN count(DISTINCT l_suppkey % 3) FILTER (l_suppkey % 4 <> 0) = 1
      THEN CAST(min(l_suppkey % 3) FILTER (l_suppkey % 4 <> 0) AS VARCHAR) END AS frame_version_key
    FROM lineitem GROUP BY ALL""",
)
def _j11(spark, sf):
    """Orders play videos, line items their snapshots, suppliers the ingestion runs."""
    items = table(spark, sf, "lineitem")
    snapshots = items.select(F.col("l_orderkey").alias("video_key"), F.col("l_suppkey").alias("ingestion_run_id"))
    s = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").select(
        s.alias("ingestion_run_id"),
        F.when(s % 4 == 0, F.lit("CHANNEL")).otherwise(F.lit("FRAME")).alias("resource_scope_type"),
        F.lit("channels.list").alias("endpoint"),
        (s % 3).cast("string").alias("resource_scope_id"),
    )
    links = snapshots.select("video_key").distinct()
    return joins.unique_frame_of_videos(links, snapshots, runs)


@query(
    "j12_strata_seed",
    """WITH s AS (SELECT t || ' x ' || f AS stratum_name, t <> 'UNCLASSIFIED' AND f <> 'UNCLASSIFIED' AS analytical_eligibility,
        regexp_replace(md5(t || ':' || f), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS stratum_key
      FROM (VALUES ('BROAD_REACH_PUBLISHER'), ('CLUB_MEDIA'), ('ANALYSIS_PUBLISHER'), ('INDEPENDENT_CREATOR'), ('OTHER'),
        ('UNCLASSIFIED')) a(t), (VALUES ('A_FOCUSED'), ('B_FOCUSED'), ('MIXED_FOCUS'), ('NO_STRONG_DOMINANT_FOCUS'),
        ('UNCLASSIFIED')) b(f))
    SELECT stratum_key, s.stratum_name, analytical_eligibility, count(v.video_key) AS video_count
    FROM s LEFT JOIN (SELECT video_key, channel_type_value || ' x ' || focus_value AS stratum_name FROM videos
      JOIN pinned USING (channel_key)) v ON v.stratum_name = s.stratum_name GROUP BY ALL""",
    "videos pinned",
)
def _j12(spark, sf):
    rows = videos(spark, sf).select("video_key", "channel_key")
    labelled = joins.stratum_label(rows, pinned_snapshots(spark, sf).drop("event_version_key"), ["channel_key"])
    counts = labelled.groupBy("stratum_name").agg(F.count(F.lit(1)).alias("video_count"))
    seed = strata_seed(rows)
    return (
        seed.join(counts, "stratum_name", "left")
        .fillna(0, ["video_count"])
        .select("stratum_key", "stratum_name", "analytical_eligibility", "video_count")
    )


_VERSIONS = """SELECT o_custkey, o_orderdate AS valid_from, o_orderstatus AS status, o_orderkey,
    lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
  FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
  WHERE prev IS DISTINCT FROM o_orderstatus"""


@query(
    "j14_scd2_point_in_time",
    f"""WITH v AS ({_VERSIONS})
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, v.status
    FROM (SELECT lineitem.*, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l
    LEFT JOIN v ON v.o_custkey = l.o_custkey AND v.valid_from <= l_shipdate AND (v.valid_to IS NULL OR l_shipdate < v.valid_to)""",
)
def _j14(spark, sf):
    from eventlens.operators.history import scd2_from_history

    orders = table(spark, sf, "orders")
    versions = scd2_from_history(orders, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    items = table(spark, sf, "lineitem").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    out = joins.valid_at(items, versions, "o_custkey", "l_shipdate", ["o_orderstatus"])
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("o_orderstatus").alias("status")
    )


@query(
    "j15_as_of_cutoff",
    """SELECT c_custkey, o_orderdate AS observed_at, status FROM customer LEFT JOIN (
      SELECT o_custkey, max(o_orderdate) AS o_orderdate, max_by(o_orderstatus, (o_orderdate, o_orderstatus)) AS status
      FROM orders WHERE o_orderdate <= timestamp '1998-01-01 00:00:00' GROUP BY ALL) ON o_custkey = c_custkey""",
)
def _j15(spark, sf):
    seen = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderstatus").alias("status")
    )
    cutoff = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    customers = table(spark, sf, "customer").select("c_custkey")
    return joins.as_of(customers, seen, "c_custkey", "observed_at", cutoff, ["status"])


@query(
    "j16_orphans",
    "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _j16(spark, sf):
    return joins.missing_from(
        table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"]
    )


@query(
    "j19_salt_guard",
    """SELECT shared, count(*) AS authors FROM (SELECT user_id, event_id % 3 AS salt,
      bool_or(ts < timestamp '2024-01-15 12:00:00') AND bool_or(ts >= timestamp '2024-01-15 12:00:00') AS shared
      FROM events GROUP BY ALL) GROUP BY ALL""",
)
def _j19(spark, sf):
    """Authors are compared within one salt version only."""
    from eventlens.plans.authors import author_presence

    rows = table(spark, sf, "events").select(
        F.lit("EV1").alias("event_version_key"),
        F.lit("A").alias("target"),
        F.when(F.col("ts") < F.lit(str(EVENT_1.occurred_at)).cast("timestamp_ntz"), "PRE").otherwise("POST").alias("window_type"),
        F.col("user_id").alias("author_key"),
        (F.col("event_id") % 3).alias("salt_version_id"),
        F.col("value").alias("valence"),
    )
    both = (F.col("n_pre") > 0) & (F.col("n_post") > 0)
    return (
        author_presence(rows, "PRE", ["POST"])
        .groupBy(both.alias("shared"))
        .agg(F.count(F.lit(1)).alias("authors"))
    )


@query(
    "w1_latest_row",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _w1(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query(
    "w5_latest_frame",
    """SELECT o_orderkey AS frame_version_key, o_orderdate AS constructed_at FROM orders WHERE o_orderpriority = '2-HIGH'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""",
)
def _w5(spark, sf):
    frames = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_version_key"),
        F.col("o_orderdate").alias("constructed_at"),
        F.col("o_orderpriority").alias("frame_purpose"),
    )
    return cohort.latest_frame(frames, "2-HIGH").drop("frame_purpose")


