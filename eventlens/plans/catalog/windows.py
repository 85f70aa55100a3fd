"""Cohort ranking, balanced caps, event association, publication order."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.config import SamplingPolicy
from eventlens.operators import cohort
from eventlens.operators.completeness import publication_order
from eventlens.operators.windows import assign_windows, window_table
from eventlens.plans.catalog.base import EVENT_1, comments, query, rounded, table, videos
from eventlens.plans.catalog.history import UUID
from eventlens.plans.catalog.joins import pinned_snapshots
from eventlens.plans.catalog.scalars import ELIGIBILITY_CTE, PLAYERS

STRATUM_POLICY = SamplingPolicy("sp1", 3, "APPROVED", "stratum")
CHANNEL_POLICY = SamplingPolicy("sp1", 3, "APPROVED", "channel")

# the gate needs every channel pinned, so this fixture leaves none out
_ALL_PINNED = """pinned_all AS (SELECT channel_key, CASE WHEN n % 4 = 1 THEN 'CLUB_MEDIA' ELSE 'INDEPENDENT_CREATOR' END
      || '_x_' || CASE WHEN n % 2 = 0 THEN 'A_FOCUSED' ELSE 'B_FOCUSED' END AS stratum_name
    FROM (SELECT DISTINCT channel_key, CAST(regexp_extract(channel_key, '(\\d+)$', 1) AS INT) AS n FROM videos))"""


def _selection_sql(bucket: str) -> str:
    return f"""WITH {ELIGIBILITY_CTE}, {_ALL_PINNED},
    r AS (SELECT e.*, stratum_name, CASE WHEN is_eligible THEN row_number() OVER (PARTITION BY is_eligible, {bucket} ORDER BY
        event_matched DESC, player_matched DESC, proximity_seconds, published_at, unique_id) END AS selection_rank
      FROM (SELECT *, source_id || '/' || video_key AS unique_id FROM eligibility) e JOIN pinned_all USING (channel_key))
    SELECT video_key, channel_key, stratum_name, cohort_type, selection_rank,
      CASE WHEN NOT is_eligible THEN 'INELIGIBLE' WHEN selection_rank <= 3 THEN 'SELECTED' ELSE 'ELIGIBLE_UNSELECTED' END AS inclusion_status,
      CASE WHEN NOT is_eligible THEN reason WHEN selection_rank > 3 THEN 'EXCEEDS_STRATUM_CAP_K' END AS primary_exclusion_reason
    FROM r"""


def _candidates(spark, sf):
    """Copies share a source id, so the video key completes the ranking's tie-break."""
    unique = F.concat_ws("/", "source_id", F.col("video_key").cast("string"))
    return videos(spark, sf).withColumn("source_id", unique)


def _select(spark, sf, policy):
    out = cohort.select_cohorts(
        _candidates(spark, sf), pinned_snapshots(spark, sf, keep_all=True), EVENT_1, PLAYERS, policy
    )
    return out.select(
        "video_key", "channel_key", "stratum_name", "cohort_type", "selection_rank", "inclusion_status", "primary_exclusion_reason"
    )


@query("w2_cohort_selection", _selection_sql("stratum_name, cohort_type"), "videos")
def _w2(spark, sf):
    return _select(spark, sf, STRATUM_POLICY)


@query("w2_cohort_selection_per_channel", _selection_sql("channel_key, stratum_name, cohort_type"), "videos")
def _w2_channel(spark, sf):
    return _select(spark, sf, CHANNEL_POLICY)


_LIST_HASH = """sha256(concat_ws(':', count(*), """ + ", ".join(
    f"sum(('0x' || substr(sha256(item), {1 + 16 * i}, 16))::UBIGINT::HUGEINT)" for i in range(4)
) + "))"


@query(
    "t14_candidate_lineage",
    f"""WITH {ELIGIBILITY_CTE}, {_ALL_PINNED},
    r AS (SELECT *, concat_ws('|', row_number() OVER (PARTITION BY stratum_name, cohort_type ORDER BY event_matched DESC,
        player_matched DESC, proximity_seconds, published_at, unique_id), unique_id,
        regexp_replace(CAST(published_at AS VARCHAR), '\\.?0+$', ''), CAST(round(proximity_seconds * 1000000) AS BIGINT), {UUID.format("'EV1:' || channel_key")}) AS item
      FROM (SELECT *, source_id || '/' || video_key AS unique_id FROM eligibility WHERE is_eligible) JOIN pinned_all USING (channel_key))
    SELECT stratum_name, cohort_type, candidate_count,
      sha256('f0|EV1|sp1|3|stratum|five-criteria-1|' || stratum_name || '|' || cohort_type || '|' || items) AS candidate_list_lineage
    FROM (SELECT stratum_name, cohort_type, count(*) AS candidate_count, {_LIST_HASH} AS items FROM r GROUP BY ALL)""",
    "videos",
)
def _t14(spark, sf):
    chosen = cohort.select_cohorts(
        _candidates(spark, sf), pinned_snapshots(spark, sf, keep_all=True), EVENT_1, PLAYERS, STRATUM_POLICY
    )
    return cohort.candidate_lineage(chosen.filter("selection_rank IS NOT NULL"), STRATUM_POLICY, EVENT_1.event_key, "f0")


@query(
    "w3_balanced_cap",
    """WITH b AS (SELECT comment_key, video_key, window_type, published_at,
        floor(date_diff('microsecond', start_at, published_at) / 21600000000.0::DOUBLE)::BIGINT AS time_bucket FROM in_window),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_key, window_type, time_bucket ORDER BY published_at, comment_key) AS rnd FROM b),
      s AS (SELECT *, row_number() OVER (PARTITION BY video_key, window_type ORDER BY rnd, time_bucket) AS selection_rank,
        count(*) OVER (PARTITION BY video_key, window_type) AS window_population_count FROM r)
    SELECT comment_key, video_key, window_type, time_bucket, selection_rank, window_population_count,
      least(window_population_count, 5) AS window_selected_count,
      round(least(window_population_count, 5)::DOUBLE / window_population_count, 10) AS selection_fraction,
      selection_rank <= 5 AS is_selected FROM s""",
    "in_window",
)
def _w3(spark, sf):
    rows = assign_windows(
        comments(spark, sf).select("comment_key", "video_key", "published_at"), window_table(spark, [EVENT_1])
    )
    out = cohort.balanced_cap(rows, cap=5, bucket_hours=6)
    return rounded(out, "selection_fraction").select(
        "comment_key",
        "video_key",
        "window_type",
        "time_bucket",
        "selection_rank",
        "window_population_count",
        "window_selected_count",
        "selection_fraction",
        "is_selected",
    )


@query(
    "w4_primary_event",
    """WITH s AS (SELECT l_orderkey AS t, l_partkey AS e, max(l_discount * 10) AS score FROM lineitem GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, e) AS rn,
        lead(score) OVER (PARTITION BY t ORDER BY score DESC, e) AS second FROM s)
    SELECT t AS text_version_key, e AS event_version_key, round(score, 10) AS association_score,
      round(score - second, 10) AS margin_over_second_best,
      score >= 0.35::DOUBLE AND (second IS NULL OR score - second >= 0.05::DOUBLE) AS is_primary_event,
      CASE WHEN score >= 0.35::DOUBLE AND (second IS NULL OR score - second >= 0.05::DOUBLE) THEN 'ACCEPTED' ELSE 'AMBIGUOUS' END
        AS classification_status
    FROM r WHERE rn = 1""",
)
def _w4(spark, sf):
    scores = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("text_version_key"), F.col("l_partkey").alias("event_version_key"))
        .agg(F.max(F.col("l_discount") * 10).alias("association_score"))
        .withColumn("association_model_version_key", F.lit("m1"))
    )
    out = cohort.primary_event(scores, 0.35, 0.05).drop("association_model_version_key")
    return rounded(out, "association_score", "margin_over_second_best")


@query(
    "w7_window_sequence",
    """SELECT event_version_key, window_type, row_number() OVER (PARTITION BY event_version_key ORDER BY so) AS window_sequence, n AS comment_count
    FROM windows1 JOIN (SELECT event_version_key, window_type, count(*) AS n FROM in_window GROUP BY ALL) USING (event_version_key, window_type)""",
    "windows1 in_window",
)
def _w7(spark, sf):
    windows = window_table(spark, [EVENT_1])
    facts = comments(spark, sf).select("comment_key", "published_at")
    return (
        assign_windows(facts, windows)
        .groupBy("event_version_key", "window_type", F.col("window_sequence").cast("bigint").alias("window_sequence"))
        .agg(F.count(F.lit(1)).alias("comment_count"))
    )


@query(
    "w8_publication_order",
    """SELECT scope, count(*) AS items, count(*) FILTER (published_at > prev) AS order_violations,
      count(*) FILTER (published_at > prev) = 0 AS is_monotonic
    FROM (SELECT o_custkey AS scope, o_orderdate AS published_at,
      lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS prev FROM orders) GROUP BY ALL""",
)
def _w8(spark, sf):
    items = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("scope"),
        (F.col("o_orderkey") % 3).alias("page_number"),
        F.col("o_orderkey").alias("item_position"),
        F.col("o_orderdate").alias("published_at"),
    )
    return publication_order(items)
