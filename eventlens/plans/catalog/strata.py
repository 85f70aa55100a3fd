"""Channel stratification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions.times import ntz
from eventlens.operators import strata
from eventlens.operators.joins import stratum_label
from eventlens.plans.catalog.base import (
    ALIASES_A,
    ALIASES_B,
    EVENT_1,
    EVENT_2,
    RELEVANCE_TEXT,
    RULES,
    cte,
    mentions_sql,
    query,
    rounded,
    table,
    videos,
)
from eventlens.plans.catalog.history import UUID
from eventlens.plans.catalog.joins import pinned_snapshots
from eventlens.plans.catalog.windows import _LIST_HASH
from eventlens.session import durable
from eventlens.sources.reference_data import period_rows

BUFFER_HOURS = 24
EVENTS = (EVENT_1, EVENT_2)

_PERIODS = ", ".join(f"('{e.event_key}', timestamp '{e.occurred_at}' - to_hours({BUFFER_HOURS}))" for e in EVENTS)
_A = [a.lower() for a in sorted(ALIASES_A, key=str.lower)]
_B = [a.lower() for a in sorted(ALIASES_B, key=str.lower)]


def _hits(terms) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {mentions_sql(RELEVANCE_TEXT, [t])} THEN '{t}' END" for t in terms
    ) + ")"


cte(
    "evidence0",
    f"""SELECT *, row_number() OVER (PARTITION BY event_version_key, channel_key, source_id ORDER BY published_at, video_key) > 1 AS exact_dup
    FROM (SELECT p.event_version_key, p.e AS reference_period_end, v.*, date_diff('microsecond', published_at, p.e) AS age,
        {_hits(_A)} AS matched_a, {_hits(_B)} AS matched_b
      FROM videos v JOIN (VALUES {_PERIODS}) p(event_version_key, e)
        ON v.published_at < p.e AND v.published_at >= p.e - to_days(180) WHERE is_short IS NOT TRUE)""",
    "videos",
)
cte(
    "evidence",
    """SELECT * EXCLUDE (incl, cluster, keep, n), (exact_dup OR (incl AND n > 1 AND video_key <> keep)) AS is_duplicate,
      CASE WHEN incl AND n > 1 AND video_key <> keep THEN cluster WHEN exact_dup THEN source_id END AS duplicate_cluster_id,
      incl AND NOT (n > 1 AND video_key <> keep) AS included, matched_a <> '' AS a, matched_b <> '' AS b
    FROM (SELECT *, NOT exact_dup AND is_short IS FALSE AS incl,
        count(*) FILTER (NOT exact_dup AND is_short IS FALSE) OVER g AS n,
        arg_min(source_id, (published_at, source_id, video_key)) FILTER (NOT exact_dup AND is_short IS FALSE) OVER g AS cluster,
        arg_min(video_key, (published_at, source_id, video_key)) FILTER (NOT exact_dup AND is_short IS FALSE) OVER g AS keep
      FROM evidence0 WINDOW g AS (PARTITION BY event_version_key, channel_key, lower(trim(title))))""",
    "evidence0",
)
cte(
    "evidence_windows",
    """SELECT event_version_key, channel_key, reference_period_end, count(*) FILTER (included AND age <= 7776000000000) AS videos_primary,
      count(*) FILTER (included) AS videos_fallback,
      count(*) FILTER (included AND age <= 7776000000000) < 10 AND count(*) FILTER (included) >= 10 AS fallback_used,
      CASE WHEN count(*) FILTER (included AND age <= 7776000000000) < 10 AND count(*) FILTER (included) >= 10
        THEN 180 ELSE 90 END::BIGINT AS effective_window_days
    FROM evidence GROUP BY ALL""",
    "evidence",
)
cte(
    "counted",
    """SELECT e.*, w.effective_window_days, w.fallback_used FROM evidence e
    JOIN evidence_windows w USING (event_version_key, channel_key)
    WHERE included AND age <= effective_window_days * 86400000000""",
    "evidence",
    "evidence_windows",
)


def _label(n: str, a: str, b: str, combined: str) -> str:
    return f"""CASE WHEN ({a} + 1.0::DOUBLE) / ({b} + 1) > 4 AND {a}::DOUBLE / {n} > 0.15::DOUBLE THEN 'A_FOCUSED'
      WHEN ({b} + 1.0::DOUBLE) / ({a} + 1) > 4 AND {b}::DOUBLE / {n} > 0.15::DOUBLE THEN 'B_FOCUSED'
      WHEN {a}::DOUBLE / {n} > 0.15::DOUBLE AND {b}::DOUBLE / {n} > 0.15::DOUBLE {combined} THEN 'MIXED_FOCUS'
      ELSE 'NO_STRONG_DOMINANT_FOCUS' END"""


cte(
    "focus",
    f"""WITH s AS (SELECT event_version_key, channel_key, count(*) AS n, count(*) FILTER (a) AS va, count(*) FILTER (b) AS vb
        FROM counted GROUP BY ALL),
      l AS (SELECT w.*, coalesce(n, 0) AS eligible_video_count, coalesce(va, 0) AS a_video_count, coalesce(vb, 0) AS b_video_count,
        CASE WHEN coalesce(n, 0) < 10 THEN 'UNCLASSIFIED' ELSE {_label("n", "va", "vb", "AND va::DOUBLE / n + vb::DOUBLE / n >= 0.4::DOUBLE")} END AS focus_value
        FROM evidence_windows w LEFT JOIN s USING (event_version_key, channel_key)),
      sub AS (SELECT event_version_key, channel_key, (age - 1) // 2592000000000 AS i, count(*) AS n, count(*) FILTER (a) AS va, count(*) FILTER (b) AS vb
        FROM counted GROUP BY ALL),
      agree AS (SELECT l.event_version_key, l.channel_key, count(*) AS evaluated,
        count(*) FILTER ({_label("n", "va", "vb", "")} = focus_value) AS agreeing
        FROM sub JOIN l USING (event_version_key, channel_key) WHERE i < 3 AND n >= 3 GROUP BY ALL)
    SELECT l.*, coalesce(evaluated, 0) AS subwindows_evaluated, coalesce(agreeing, 0) AS subwindows_agreeing,
      coalesce(a_video_count::DOUBLE / nullif(eligible_video_count, 0), 0) AS a_prevalence,
      coalesce(b_video_count::DOUBLE / nullif(eligible_video_count, 0), 0) AS b_prevalence,
      CASE WHEN a_video_count >= b_video_count THEN (a_video_count + 1.0::DOUBLE) / (b_video_count + 1)
        ELSE (b_video_count + 1.0::DOUBLE) / (a_video_count + 1) END AS focus_ratio,
      CASE WHEN eligible_video_count >= 10 AND NOT fallback_used AND coalesce(agreeing, 0) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS focus_confidence
    FROM l LEFT JOIN agree USING (event_version_key, channel_key)""",
    "counted",
    "evidence_windows",
)


def _club(name, terms) -> str:
    return (
        f"SELECT event_version_key, channel_key, '{name}' AS club, count(*) AS n FROM counted "
        f"WHERE {mentions_sql(RELEVANCE_TEXT, terms)} GROUP BY ALL"
    )


cte(
    "clubs",
    """SELECT event_version_key, channel_key, max(n) AS top_n, coalesce(max(n) FILTER (rn = 2), 0) AS second_n
    FROM (SELECT *, row_number() OVER (PARTITION BY event_version_key, channel_key ORDER BY n DESC, club DESC) AS rn FROM ("""
    + " UNION ALL ".join(_club(n, t) for n, t in RULES.clubs)
    + ")) GROUP BY ALL",
    "counted",
)
cte(
    "about",
    """SELECT source AS channel_key, CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 7 = 0 THEN ''
      ELSE 'About ' || source END AS about_description FROM documents GROUP BY ALL""",
)
cte(
    "types",
    f"""SELECT w.event_version_key, w.channel_key, round(share, 10) AS club_share, round(runner, 10) AS runner_up_share,
      round(analysis, 10) AS analysis_share, CASE WHEN about_description = '' OR n < 10 THEN 'UNCLASSIFIED'
        WHEN w.channel_key IN ('src3', 'src11') THEN 'BROAD_REACH_PUBLISHER'
        WHEN share > 0.7::DOUBLE AND share - runner >= 0.1::DOUBLE THEN 'CLUB_MEDIA'
        WHEN w.channel_key IN ('src5') THEN 'ANALYSIS_PUBLISHER' WHEN analysis >= 0.5::DOUBLE THEN 'ANALYSIS_PUBLISHER'
        ELSE 'INDEPENDENT_CREATOR' END AS channel_type_value,
      CASE WHEN about_description = '' OR n < 10 THEN 'LOW' WHEN w.channel_key IN ('src3', 'src11') THEN 'HIGH'
        WHEN share > 0.7::DOUBLE AND share - runner >= 0.1::DOUBLE THEN CASE WHEN share > 0.9::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END
        WHEN w.channel_key IN ('src5') THEN 'HIGH' WHEN analysis >= 0.5::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS channel_type_confidence
    FROM (SELECT w.event_version_key, w.channel_key, coalesce(n, 0) AS n, coalesce(top_n::DOUBLE / n, 0) AS share,
        coalesce(second_n::DOUBLE / n, 0) AS runner, coalesce(k::DOUBLE / n, 0) AS analysis
      FROM evidence_windows w LEFT JOIN (SELECT event_version_key, channel_key, count(*) AS n,
          count(*) FILTER ({mentions_sql(RELEVANCE_TEXT, RULES.analysis_keywords)}) AS k FROM counted GROUP BY ALL)
        USING (event_version_key, channel_key) LEFT JOIN clubs USING (event_version_key, channel_key)) w
    JOIN about USING (channel_key)""",
    "evidence_windows",
    "counted",
    "clubs",
    "about",
)


def evidence(spark, sf):
    periods = period_rows(spark, EVENTS, BUFFER_HOURS)
    return strata.channel_evidence(videos(spark, sf), periods, ALIASES_A, ALIASES_B, RULES)


def channels(spark, sf):
    n = F.regexp_extract("channel_key", r"(\d+)$", 1).cast("int")
    about = F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("About "), "channel_key"))
    return (
        table(spark, sf, "documents")
        .select(F.col("source").alias("channel_key"))
        .distinct()
        .select("channel_key", F.col("channel_key").alias("source_channel_id"), about.alias("about_description"))
    )


KEYS = ["event_version_key", "channel_key"]


@query(
    "t10_exact_duplicates",
    """SELECT event_version_key, channel_key, video_key, source_id, exact_dup AS is_duplicate,
      CASE WHEN exact_dup THEN source_id END AS duplicate_cluster_id FROM evidence0""",
    "evidence0",
)
def _t10(spark, sf):
    from dataclasses import replace

    rules = replace(RULES, deduplication_rule_version="EXPLICIT_NONE")
    periods = period_rows(spark, EVENTS, BUFFER_HOURS)
    items = strata.channel_evidence(videos(spark, sf), periods, ALIASES_A, ALIASES_B, rules)
    return items.select(*KEYS, "video_key", "source_id", "is_duplicate", "duplicate_cluster_id")


@query(
    "t11_cross_item_rule",
    """SELECT event_version_key, channel_key, video_key, is_duplicate, duplicate_cluster_id, included AS included_in_prevalence,
      matched_a, matched_b FROM evidence""",
    "evidence",
)
def _t11(spark, sf):
    return evidence(spark, sf).select(
        *KEYS,
        "video_key",
        "is_duplicate",
        "duplicate_cluster_id",
        "included_in_prevalence",
        F.array_join("matched_a", ",").alias("matched_a"),
        F.array_join("matched_b", ",").alias("matched_b"),
    )


_MANIFEST = f"""SELECT event_version_key, channel_key, {_LIST_HASH} AS evidence_manifest_hash
    FROM (SELECT *, concat_ws('|', source_id, regexp_replace(CAST(published_at AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'),
      coalesce(CAST(is_short AS VARCHAR), 'null'), matched_a, matched_b, CAST(is_duplicate AS VARCHAR), CAST(included AS VARCHAR)) AS item
      FROM evidence) GROUP BY ALL"""


@query("t13_manifest_hash", _MANIFEST, "evidence")
def _t13(spark, sf):
    return strata.manifest_hash(evidence(spark, sf))


@query(
    "g4_evidence_window",
    """SELECT event_version_key, channel_key, reference_period_end - to_days(effective_window_days::INT) AS reference_period_start,
      reference_period_end, videos_primary, videos_fallback, fallback_used, effective_window_days FROM evidence_windows""",
    "evidence_windows",
)
def _g4(spark, sf):
    return strata.evidence_window(strata.channel_statistics(evidence(spark, sf), RULES))


def focus(spark, sf):
    return strata.classify_focus(strata.channel_statistics(evidence(spark, sf), RULES), RULES)


@query(
    "g3_evidence_counts",
    """SELECT event_version_key, channel_key, eligible_video_count, a_video_count, b_video_count, round(a_prevalence, 10) AS a_prevalence,
      round(b_prevalence, 10) AS b_prevalence, round(focus_ratio, 10) AS focus_ratio FROM focus""",
    "focus",
)
def _g3(spark, sf):
    out = rounded(focus(spark, sf), "a_prevalence", "b_prevalence", "focus_ratio")
    return out.select(
        *KEYS, "eligible_video_count", "a_video_count", "b_video_count", "a_prevalence", "b_prevalence", "focus_ratio"
    )


@query("g5_focus_classifier", "SELECT event_version_key, channel_key, focus_value FROM focus", "focus")
def _g5(spark, sf):
    return focus(spark, sf).select(*KEYS, "focus_value")


@query(
    "g6_subwindow_stability",
    "SELECT event_version_key, channel_key, focus_confidence, subwindows_evaluated, subwindows_agreeing FROM focus",
    "focus",
)
def _g6(spark, sf):
    return focus(spark, sf).select(*KEYS, "focus_confidence", "subwindows_evaluated", "subwindows_agreeing")


@query("g7_type_classifier", "SELECT * FROM types", "types")
def _g7(spark, sf):
    items = evidence(spark, sf)
    out = strata.classify_type(strata.channel_statistics(items, RULES), items, channels(spark, sf), RULES)
    return rounded(out, "club_share", "runner_up_share", "analysis_share").select(
        *KEYS, "channel_type_value", "channel_type_confidence", "club_share", "runner_up_share", "analysis_share"
    )


ASSESSED_AT = "2024-01-14 12:00:00"


def assessments(spark, sf):
    return strata.assess_channels(evidence(spark, sf), channels(spark, sf), RULES, ntz(ASSESSED_AT))


@query(
    "g8_assessment_record",
    f"""SELECT event_version_key, channel_key, focus_value, channel_type_value, eligible_video_count, evidence_manifest_hash,
      {UUID.format("channel_type_value || ':' || focus_value")} AS stratum_key
    FROM focus JOIN types USING (event_version_key, channel_key) JOIN ({_MANIFEST}) USING (event_version_key, channel_key)""",
    "focus types evidence",
)
def _g8(spark, sf):
    return assessments(spark, sf).select(
        *KEYS, "focus_value", "channel_type_value", "eligible_video_count", "evidence_manifest_hash", "stratum_key"
    )


@query(
    "g9_headline_eligibility",
    """SELECT event_version_key, channel_key, focus_value <> 'UNCLASSIFIED' AND channel_type_value <> 'UNCLASSIFIED'
      AND NOT fallback_used AS headline_decomposition_eligible FROM focus JOIN types USING (event_version_key, channel_key)""",
    "focus types",
)
def _g9(spark, sf):
    return assessments(spark, sf).select(*KEYS, "headline_decomposition_eligible")


@query(
    "t12_snapshot_verify",
    """SELECT event_version_key, channel_key, CASE WHEN event_version_key = 'EV2' THEN 'INSERTED'
      WHEN eligible_video_count % 2 = 0 THEN 'IDEMPOTENT_NOOP' ELSE 'VIOLATION' END AS status,
      round(focus_ratio, 5) AS focus_ratio, round(a_prevalence, 5) AS a_prevalence
    FROM focus JOIN types USING (event_version_key, channel_key)""",
    "focus types",
)
def _t12(spark, sf):
    """The first event is pinned already; odd counts were pinned with half a second of drift."""
    candidates = durable(assessments(spark, sf))  # assessments are a stored table
    drift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.5).cast("decimal(18,6)"))
    pinned = candidates.filter("event_version_key = 'EV1'").withColumn(
        "reference_period_end",
        F.when(F.col("eligible_video_count") % 2 == 0, F.col("reference_period_end")).otherwise(
            F.col("reference_period_end") + drift
        ),
    )
    out = strata.compare_snapshots(pinned, candidates)
    return out.select(*KEYS, "status", "focus_ratio", "a_prevalence")


@query(
    "t16_override",
    f"""WITH s AS (SELECT channel_key, channel_type_value AS t, focus_value AS f, CAST(regexp_extract(channel_key, '(\\d+)$', 1) AS INT) AS n
        FROM focus JOIN types USING (event_version_key, channel_key) WHERE event_version_key = 'EV1'),
      o AS (SELECT *, CASE WHEN n % 3 = 1 THEN 'OTHER' ELSE t END AS t2, CASE WHEN n % 3 = 2 THEN 'MIXED_FOCUS' ELSE f END AS f2 FROM s)
    SELECT channel_key, {UUID.format("t || ':' || f")} AS stratum_key, timestamp '{ASSESSED_AT}' AS valid_from,
      CASE WHEN n % 3 <> 0 THEN timestamp '2024-01-14 18:00:00' END AS valid_to, n % 3 = 0 AS is_current FROM o
    UNION ALL SELECT channel_key, {UUID.format("t2 || ':' || f2")}, timestamp '2024-01-14 18:00:00', NULL, TRUE FROM o WHERE n % 3 <> 0""",
    "focus types",
)
def _t16(spark, sf):
    """A third of the channels gets a type override, a third a focus override, the rest a pending one."""
    current = durable(assessments(spark, sf).filter("event_version_key = 'EV1'"))
    versions = current.select(
        "channel_key",
        "stratum_key",
        F.col("assessed_at").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    n = F.regexp_extract("channel_key", r"(\d+)$", 1).cast("int") % 3
    overrides = versions.select(
        "channel_key",
        F.when(n == 1, "CHANNEL_TYPE").otherwise("FOCUS").alias("axis"),
        F.when(n == 1, "OTHER").otherwise("MIXED_FOCUS").alias("proposed_axis_value"),
        F.when(n != 0, F.lit("reviewer")).alias("approved_by"),
        F.when(n != 0, ntz("2024-01-14 18:00:00")).alias("approved_at"),
    )
    return strata.apply_overrides(versions, strata.strata_seed(versions), overrides)


@query(
    "g20_window_sensitivity",
    f"""WITH s AS (SELECT event_version_key, channel_key, d::BIGINT AS window_days,
        count(*) FILTER (age <= d * 86400000000) AS n, count(*) FILTER (a AND age <= d * 86400000000) AS va,
        count(*) FILTER (b AND age <= d * 86400000000) AS vb
        FROM evidence, (VALUES (60), (90), (180)) w(d) WHERE included GROUP BY ALL)
    SELECT event_version_key, channel_key, window_days, n AS video_count, CASE WHEN n < 10 THEN 'UNCLASSIFIED'
      ELSE {_label("n", "va", "vb", "AND va::DOUBLE / n + vb::DOUBLE / n >= 0.4::DOUBLE")} END AS focus_value FROM s""",
    "evidence",
)
def _g20(spark, sf):
    return strata.window_sensitivity(evidence(spark, sf), RULES)


def _candidates(spark, sf):
    rows = videos(spark, sf).select(
        "video_key",
        "channel_key",
        F.when(F.col("video_key") % 3 == 0, "EVENT").when(F.col("video_key") % 3 == 1, "BASELINE").alias("cohort_type"),
    )
    return stratum_label(rows, pinned_snapshots(spark, sf).drop("event_version_key"), ["channel_key"])


cte(
    "breakdown",
    """SELECT coalesce(channel_type_value || ' x ' || focus_value, 'UNCLASSIFIED') AS stratum_name,
      CASE video_key % 3 WHEN 0 THEN 'EVENT' WHEN 1 THEN 'BASELINE' ELSE 'UNASSIGNED' END AS cohort_type, channel_key,
      count(DISTINCT video_key) AS candidate_count FROM videos LEFT JOIN pinned USING (channel_key) GROUP BY ALL""",
    "videos",
    "pinned",
)


@query("g1_channel_breakdown", "SELECT * FROM breakdown", "breakdown")
def _g1(spark, sf):
    return strata.channel_breakdown(_candidates(spark, sf))


@query(
    "g2_stratum_distribution",
    """SELECT stratum_name, cohort_type, count(*) AS participating_channel_count,
      CAST(sum(candidate_count) AS BIGINT) AS aggregate_candidate_count, min(candidate_count) AS min,
      quantile_cont(candidate_count::DOUBLE, 0.25) AS p25, quantile_cont(candidate_count::DOUBLE, 0.5) AS median,
      quantile_cont(candidate_count::DOUBLE, 0.75) AS p75, max(candidate_count) AS max FROM breakdown GROUP BY ALL""",
    "breakdown",
)
def _g2(spark, sf):
    return strata.stratum_distribution(_candidates(spark, sf))


cte(
    "scans",
    """SELECT channel_key, '90D_PRIMARY' AS scan_scope, timestamp '2024-01-14 12:00:00' - to_days(10 + n) AS window_start_at,
      timestamp '2024-01-14 12:00:00' AS window_end_at, CASE WHEN n % 4 = 3 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
      (SELECT count(*) FROM videos v WHERE v.channel_key = c.channel_key AND is_short IS FALSE
        AND (resolution_status = 'RESOLVED' OR resolution_status IS NULL) AND published_at < timestamp '2024-01-14 12:00:00'
        AND published_at >= timestamp '2024-01-14 12:00:00' - to_days(10 + n)) AS eligible_videos_observed
    FROM (SELECT channel_key, CAST(regexp_extract(channel_key, '(\\d+)$', 1) AS INT) * 8 AS n FROM videos GROUP BY ALL) c""",
    "videos",
)


def scans(spark, sf):
    n = F.regexp_extract("channel_key", r"(\d+)$", 1).cast("int") * 8
    rows = videos(spark, sf).withColumn("source_id", F.col("video_key").cast("string"))
    end = ntz("2024-01-14 12:00:00")
    open_scans = rows.select("channel_key").distinct().select(
        "channel_key",
        F.lit("90D_PRIMARY").alias("scan_scope"),
        (end - F.make_dt_interval(n + 10)).alias("window_start_at"),
        end.alias("window_end_at"),
        F.when(n % 4 == 3, F.lit("PARTIAL")).otherwise(F.lit("COMPLETED")).alias("status"),
    )
    return strata.eligible_in_window(rows.drop("resolution_status"), rows, open_scans)


@query(
    "g10_eligible_in_window",
    "SELECT channel_key, scan_scope, status, window_start_at, window_end_at, eligible_videos_observed FROM scans",
    "scans",
)
def _g10(spark, sf):
    return scans(spark, sf).select(
        "channel_key", "scan_scope", "status", "window_start_at", "window_end_at", "eligible_videos_observed"
    )


@query(
    "g11_fallback_scans",
    """SELECT channel_key, '180D_FALLBACK' AS scan_scope, window_end_at - to_days(180) AS window_start_at, window_end_at, 'PENDING' AS status
    FROM scans WHERE status = 'COMPLETED' AND eligible_videos_observed < 10""",
    "scans",
)
def _g11(spark, sf):
    return strata.fallback_scans(scans(spark, sf), RULES)
