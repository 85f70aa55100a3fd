"""Data-quality rules over whole tables; rows returned are violations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from eventlens.operators import quality
from eventlens.operators.cohort import attribute_engagement
from eventlens.operators.history import scd2_from_history, text_versions
from eventlens.operators.ordered import dealt
from eventlens.operators.windows import config_table
from eventlens.plans import reaction
from eventlens.plans.catalog.base import (
    EVENT_1,
    EVENT_2,
    NEGATIVE_BELOW,
    POSITIVE_ABOVE,
    assignments,
    comments,
    cte,
    opinions,
    query,
    rounded,
    table,
    targeted,
)
from eventlens.plans.catalog.history import observations
from eventlens.plans.catalog.incremental import states
from eventlens.plans.catalog.joins import _VERSIONS
from eventlens.sources.reference_data import period_rows
from eventlens.plans.catalog.metrics import (
    _DECOMPOSITION,
    _MEASURES,
    _NARRATIVE_SQL,
    _REACTION,
    MINIMUM,
    decomposition_mart,
)


@query(
    "q1_duplicate_keys",
    "SELECT source, md5(text) AS text_hash, count(*) AS row_count FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def _q1(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.md5("text").alias("text_hash"))
    return quality.duplicate_keys(docs, ["source", "text_hash"])


@query(
    "q2_duplicate_target_model",
    """SELECT l_orderkey AS comment_target_key, l_returnflag AS model_version_key, count(*) AS row_count FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
)
def _q2(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("comment_target_key"), F.col("l_returnflag").alias("model_version_key")
    )
    return quality.duplicate_keys(rows, ["comment_target_key", "model_version_key"])


@query(
    "q3_duplicate_bridge",
    "SELECT comment_key, target, 2::BIGINT AS row_count FROM targeted WHERE comment_key % 41 = 0",
    "targeted",
)
def _q3(spark, sf):
    """A bridge that a faulty rerun wrote again for every 41st comment."""
    return quality.duplicate_keys(written_again(targeted(comments(spark, sf))), ["comment_key", "target"])


def written_again(rows):
    return rows.unionByName(rows.filter(F.col("comment_key") % 41 == 0))


@query(
    "q4_decomposition_residual",
    f"""SELECT event_version_key, target, round(abs(m019_composition_effect + tone - shared_shift), 6) AS residual
    FROM (SELECT *, m020_tone_effect + CASE WHEN target = 'A' THEN 0.01::DOUBLE ELSE 0 END AS tone FROM ({_DECOMPOSITION}))
    WHERE abs(m019_composition_effect + tone - shared_shift) > 0.0001::DOUBLE""",
    "contributions",
)
def _q4(spark, sf):
    """A mart whose tone effect of A a faulty writer raised by a hundredth."""
    raised = F.when(F.col("target") == "A", F.lit(0.01)).otherwise(F.lit(0.0))
    mart = decomposition_mart(spark, sf).withColumn("m020_tone_effect", F.col("m020_tone_effect") + raised)
    out = quality.additivity_residuals(mart)
    return rounded(out, "residual", digits=6).select("event_version_key", "target", "residual")


@query(
    "q5_engagement_conservation",
    """SELECT s AS source_likes, a AS allocated_likes FROM (SELECT (SELECT sum(likes) FROM comments)::DOUBLE AS s,
      (SELECT sum(likes::DOUBLE / n * CASE WHEN comment_key % 41 = 0 THEN 2 ELSE 1 END)
       FROM (SELECT comment_key, likes, count(*) OVER (PARTITION BY comment_key) AS n FROM targeted)) AS a)
    WHERE abs(s - a) > 0.0001::DOUBLE""",
    "comments targeted",
)
def _q5(spark, sf):
    """Allocated likes that a faulty rerun wrote again for every 41st comment."""
    rows = comments(spark, sf)
    return quality.engagement_conservation(rows, written_again(attribute_engagement(targeted(rows)))).drop("residual")


@query(
    "q6_foreign_samples",
    "SELECT comment_key, sample_type FROM comments WHERE sample_type <> 'CHRONOLOGICAL'",
    "comments",
)
def _q6(spark, sf):
    return quality.foreign_samples(comments(spark, sf)).select("comment_key", "sample_type")


@query(
    "q7_duplicate_comments",
    "SELECT source_comment_id, count(*) AS row_count FROM observations GROUP BY ALL HAVING count(*) > 1",
    "observations",
)
def _q7(spark, sf):
    return quality.duplicate_keys(observations(spark, sf), ["source_comment_id"])


@query(
    "q8_unresolved_opinions",
    "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def _q8(spark, sf):
    bridge = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    # a row without a key is neither in nor out
    return quality.unresolved(dealt(rows.filter("l_orderkey IS NOT NULL"), ["l_orderkey"]), bridge, ["l_orderkey"])


cte(
    "order_runs",
    """SELECT l_orderkey AS ingestion_run_id, count(*) AS pages_requested, CAST(sum(l_quantity) AS BIGINT) AS records_observed
    FROM lineitem GROUP BY ALL""",
)


@query(
    "q9_capped_runs",
    "SELECT * FROM order_runs WHERE records_observed > 150 OR pages_requested > 6",
    "order_runs",
)
def _q9(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ingestion_run_id")).agg(
        F.count(F.lit(1)).alias("pages_requested"), F.sum("l_quantity").cast("bigint").alias("records_observed")
    )
    return quality.capped_runs(runs, comment_cap=150, page_cap=6)


@query(
    "q10_false_completions",
    """SELECT scope, continuity_status FROM continuity
    WHERE continuity_status = 'COMPLETE_TO_WATERMARK' AND NOT watermark_reached""",
    "continuity",
)
def _q10(spark, sf):
    return quality.false_completions(states(spark, sf)).select("scope", "continuity_status")


@query(
    "q11_one_current_version",
    f"""WITH v AS (SELECT o_custkey % 700 AS event_key, valid_to IS NULL AS is_current FROM ({_VERSIONS}))
    SELECT event_key, count(*) FILTER (is_current) AS flagged_count FROM v GROUP BY ALL HAVING count(*) FILTER (is_current) <> 1""",
)
def _q11(spark, sf):
    versions = scd2_from_history(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    keyed = versions.select((F.col("o_custkey") % 700).alias("event_key"), "is_current")
    return quality.not_exactly_one(keyed, ["event_key"], F.col("is_current"))


@query(
    "q12_overlapping_versions",
    """WITH v AS (SELECT o_custkey AS channel_key, o_orderkey, o_orderdate AS valid_from, o_orderdate + to_days(o_orderkey % 60) AS valid_to FROM orders),
      n AS (SELECT *, lead(valid_from) OVER (PARTITION BY channel_key ORDER BY valid_from, valid_to, o_orderkey) AS next_from FROM v)
    SELECT channel_key, valid_from, valid_to, next_from FROM n WHERE next_from < valid_to""",
)
def _q12(spark, sf):
    versions = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("channel_key"),
        F.col("o_orderdate").alias("valid_from"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 60).cast("int"))).alias("valid_to"),
    )
    return quality.overlapping_versions(versions, "channel_key")


@query(
    "q13_one_latest_text",
    """SELECT source_comment_id, 2::BIGINT AS flagged_count FROM observations WHERE run = 2 AND event_id % 5 = 0 AND event_id % 3 = 0""",
    "observations",
)
def _q13(spark, sf):
    """Text versions whose flag a faulty writer left set on every third comment."""
    versions = text_versions(observations(spark, sf))
    third = F.substring("source_comment_id", 2, 20).cast("bigint") % 3 == 0
    return quality.not_exactly_one(versions, ["source_comment_id"], F.col("is_latest_version") | third)


@query(
    "q14_primary_target",
    """SELECT comment_key, count(*) AS flagged_count FROM targeted WHERE resolution_status = 'ACCEPTED'
    GROUP BY ALL HAVING count(*) > 1""",
    "targeted",
)
def _q14(spark, sf):
    rows = targeted(comments(spark, sf))
    return quality.more_than_one(rows, ["comment_key"], F.col("resolution_status") == "ACCEPTED")


@query(
    "q14_primary_narrative",
    """SELECT comment_key, target, count(*) FILTER (first AND stance IS NOT NULL) AS accepted_primary_count,
      count(*) FILTER (first) AS primary_count FROM (SELECT *, is_primary OR comment_key % 8 = 0 AS first FROM assignments)
    GROUP BY ALL HAVING count(*) FILTER (first AND stance IS NOT NULL) > 0 AND count(*) FILTER (first) <> 1""",
    "assignments",
)
def _q14_narrative(spark, sf):
    """Assignments whose flag a faulty writer set on all narratives of every eighth comment."""
    rows = assignments(opinions(spark, sf))
    flag = F.col("is_primary") | (F.col("comment_key") % 8 == 0)
    return quality.primary_missing_or_repeated(rows, ["comment_key", "target"], flag, F.col("stance").isNotNull())


@query(
    "q15_spans_outside_text",
    """SELECT conv_id, turn, turn * 20 - 5 AS evidence_start, conv_id % 200 AS evidence_end FROM conversations
    WHERE NOT (turn * 20 - 5 >= 0 AND conv_id % 200 <= length(text) AND turn * 20 - 5 < conv_id % 200)""",
)
def _q15(spark, sf):
    spans = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        "text",
        (F.col("turn") * 20 - 5).alias("evidence_start"),
        (F.col("conv_id") % 200).alias("evidence_end"),
    )
    return quality.spans_outside(spans).drop("text")


@query(
    "q16_mixed_versions",
    """SELECT l_orderkey AS mart_key, count(DISTINCT l_returnflag) AS version_count FROM lineitem
    GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""",
)
def _q16(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mart_key"), F.col("l_returnflag").alias("model"))
    return quality.mixed_versions(rows, ["mart_key"], "model")


@query(
    "q17_incompatible_constructs",
    """SELECT DISTINCT event_type AS construct_key, 'task' || (event_id % 3) AS model_task, 'subject' || (event_id % 2) AS subject_type FROM events
    WHERE NOT (event_type IN ('click', 'view') AND event_id % 3 = 0) AND NOT (event_type = 'error' AND event_id % 2 = 1)""",
)
def _q17(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("construct_key"),
        F.concat(F.lit("task"), (e % 3).cast("string")).alias("model_task"),
        F.concat(F.lit("subject"), (e % 2).cast("string")).alias("subject_type"),
    )
    allowed = [(c, "task0", f"subject{s}") for c in ("click", "view") for s in (0, 1)]
    allowed += [("error", f"task{t}", "subject1") for t in (0, 1, 2)]
    columns = [list(c) for c in zip(*allowed)]
    names = ("construct_key", "model_task", "subject_type")
    return quality.incompatible_constructs(
        rows, config_table(spark, {n: (pa.string(), v) for n, v in zip(names, columns)})
    )


@query(
    "q18_share_sums",
    f"""SELECT 'm010' AS metric, event_version_key, target, window_type, round(positive_share + neutral_share, 10) AS share_sum
    FROM (SELECT event_version_key, target, window_type, avg((valence > {POSITIVE_ABOVE})::INT) AS positive_share,
      avg((valence BETWEEN {NEGATIVE_BELOW} AND {POSITIVE_ABOVE})::INT) AS neutral_share FROM opinions GROUP BY ALL)
    WHERE abs(positive_share + neutral_share - 1) > 0.000001::DOUBLE
    UNION ALL SELECT 'm022', event_version_key, target, window_type, round(s, 10) FROM (SELECT event_version_key, target, window_type,
      sum(m022_primary_share) AS s FROM ({_NARRATIVE_SQL}) GROUP BY ALL) WHERE abs(s - 1) > 0.000001::DOUBLE""",
    "opinions assignments",
)
def _q18(spark, sf):
    """Narrative shares must pass; two of the three valence bands alone must be reported."""
    from eventlens.plans.catalog.metrics import narrative_mart

    keys = ["event_version_key", "target", "window_type"]
    shares = reaction.valence_shares(opinions(spark, sf), NEGATIVE_BELOW, POSITIVE_ABOVE)
    bands = quality.shares_not_one(shares, keys, F.col("positive_share") + F.col("neutral_share"))
    stories = quality.shares_not_one(narrative_mart(spark, sf), keys, F.col("m022_primary_share"))
    both = bands.withColumn("metric", F.lit("m010")).unionByName(stories.withColumn("metric", F.lit("m022")))
    return rounded(both, "share_sum")


@query(
    "q19_bounds",
    """SELECT event_id, value / 100 AS share, (value - 50) / 100 AS valence FROM events
    WHERE value / 100 NOT BETWEEN 0 AND 1 OR (value - 50) / 100 NOT BETWEEN -1 AND 1""",
)
def _q19(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 100).alias("share"), ((F.col("value") - 50) / 100).alias("valence")
    )
    return quality.out_of_bounds(rows, {"share": (0, 1), "valence": (-1, 1)})


@query(
    "q20_shown_below_threshold",
    f"""SELECT event_version_key, target, window_type, m008_mean_valence FROM ({_REACTION})
    JOIN (SELECT event_version_key, window_type, sample_status FROM ({_MEASURES})) USING (event_version_key, window_type)
    WHERE sample_status = 'INSUFFICIENT_SAMPLE' AND m008_mean_valence IS NOT NULL""",
    "in_window opinions opinions_tox",
)
def _q20(spark, sf):
    """The ungated mart joined with its sample status: what must not be shown."""
    from eventlens.operators.cohort import cohort_gate
    from eventlens.plans import coverage
    from eventlens.plans.catalog.base import comments_in_window

    status = cohort_gate(coverage.sample_measures(comments_in_window(spark, sf), opinions(spark, sf)), MINIMUM)
    mart = reaction.mean_valence(opinions(spark, sf)).join(
        status.select(*coverage.WINDOW, "sample_status"), list(coverage.WINDOW)
    )
    out = quality.shown_below_threshold(mart, "m008_mean_valence")
    return rounded(out, "m008_mean_valence").select("event_version_key", "target", "window_type", "m008_mean_valence")


@query(
    "q21_untraceable_comments",
    """SELECT comment_key FROM (SELECT event_id AS comment_key FROM events)
    WHERE comment_key % 50 = 0 OR comment_key % 31 = 0""",
)
def _q21(spark, sf):
    """Every fiftieth page is missing, every 31st observation lost its position."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(e.alias("comment_key"))
    observed = table(spark, sf, "events").select(
        e.alias("comment_key"),
        e.cast("string").alias("raw_response_id"),
        F.when(e % 31 != 0, F.lit(0)).alias("source_item_position"),
    )
    pages = table(spark, sf, "events").filter(e % 50 != 0).select(e.cast("string").alias("raw_response_id"))
    return quality.untraceable(rows, observed, pages)


@query(
    "q22_pilot_in_research",
    """SELECT o_orderkey, o_custkey AS frame_version_key FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus <> 'P' AND (c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL)""",
)
def _q22(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("frame_version_key"),
        F.when(F.col("o_orderstatus") == "P", "INTEGRATION_TEST").otherwise("RESEARCH").alias("run_purpose"),
    )
    frames = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("frame_version_key"),
        F.when(F.col("c_mktsegment") == "BUILDING", "PIPELINE_PILOT").otherwise("RESEARCH_PANEL").alias("frame_purpose"),
    )
    return quality.pilot_rows_in_research(rows, frames).select("o_orderkey", "frame_version_key")


@query(
    "q23_leaked_evidence",
    """SELECT event_id AS evidence_key, CASE WHEN event_id % 2 = 0 THEN 'EV1' ELSE 'EV2' END AS event_version_key, ts AS published_at FROM events
    WHERE ts >= CASE WHEN event_id % 2 = 0 THEN timestamp '2024-01-14 12:00:00' ELSE timestamp '2024-01-08 20:30:00' END""",
)
def _q23(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("evidence_key"),
        F.col("ts").alias("published_at"),
        F.when(F.col("event_id") % 2 == 0, F.lit("EV1")).otherwise(F.lit("EV2")).alias("event_version_key"),
    )
    return quality.leaked_evidence(rows, period_rows(spark, [EVENT_1, EVENT_2], 24))


@query(
    "q24_unapproved_parameters",
    """SELECT s_suppkey AS parameter_key, s_name AS parameter_name FROM supplier WHERE s_acctbal < 0""",
)
def _q24(spark, sf):
    """Parameters whose status is not approved although a rule uses them."""
    parameters = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("parameter_key"),
        F.col("s_name").alias("parameter_name"),
        F.when(F.col("s_acctbal") < 0, "HUMAN_APPROVAL_REQUIRED").otherwise("APPROVED").alias("status"),
    )
    return quality.unapproved_parameters(parameters).drop("status")


