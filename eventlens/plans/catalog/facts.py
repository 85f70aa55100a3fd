"""The opinion fact assembled from canonical tables, and the remaining inventory names."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.functions.keys import md5_uuid
from eventlens.operators import quality
from eventlens.operators.windows import window_table
from eventlens.plans.authors import author_presence
from eventlens.plans.catalog import metrics  # noqa: F401  (its derived tables are used here)
from eventlens.plans.catalog.base import (
    EVENT_1,
    EVENT_2,
    LANGUAGE_THRESHOLD,
    POST,
    PRE,
    comments,
    opinions,
    query,
    rounded,
    table,
    targeted,
)
from eventlens.plans.opinions import opinion_fact

EVENTS = (EVENT_1, EVENT_2)


def canonical_tables(spark, sf):
    """Comment, text version, language, target, inference, video and snapshot tables from `events`.

    Every comment has an outdated and a latest text version; every target is resolved by two
    models, of which one is pinned.
    """
    base = comments(spark, sf)
    c = F.col("comment_key")
    versions = base.select(
        "comment_key", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("_v")
    ).select(
        "comment_key",
        md5_uuid(c, F.col("_v")).alias("text_version_key"),
        (F.col("_v") == "new").alias("is_latest_version"),
    )
    newest = md5_uuid(c, F.lit("new"))
    languages = base.select(
        newest.alias("text_version_key"),
        "language_code",
        F.col("language_confidence").alias("confidence"),
        F.lit("ACCEPTED").alias("classification_status"),
    )
    spoken = targeted(base)
    key = md5_uuid(c, F.col("target"))
    targets = spoken.select(
        newest.alias("text_version_key"),
        key.alias("comment_target_key"),
        F.col("target").alias("target_entity_key"),
        F.explode(F.array(F.lit("model_a"), F.lit("model_b"))).alias("target_resolution_model_version_key"),
        F.col("resolution_status").alias("classification_status"),
    )

    def output(construct, label, score, status):
        return F.struct(
            F.lit(construct).alias("construct_key"),
            label.cast("string").alias("predicted_label"),
            score.cast("double").alias("score"),
            status.alias("classification_status"),
        )

    outputs = F.array(
        output("valence", F.lit(None), F.col("valence"), F.lit("ACCEPTED")),
        output("derision", F.col("derision_label"), F.lit(None), F.col("derision_status")),
    )
    inferences = spoken.select(
        key.alias("subject_key"), F.col("published_at").alias("processed_at"), F.explode(outputs).alias("_o")
    ).select("subject_key", "processed_at", "_o.*")
    videos = base.select("video_key", "channel_key").distinct()
    snapshots = (
        base.select("channel_key", "channel_type_value")
        .distinct()
        .withColumn("event_version_key", F.explode(F.array(*[F.lit(e.event_key) for e in EVENTS])))
        .withColumn("focus_value", F.lit("MIXED_FOCUS"))
    )
    facts = base.select("comment_key", "video_key", "salt_version_id", "author_key", "published_at", "sample_type", "exclusion_reason")
    return facts, versions, languages, targets, inferences, videos, snapshots


@query(
    "e4_opinion_fact",
    """SELECT t.comment_key, w.event_version_key, w.window_type, t.target, t.video_key, t.channel_key, t.salt_version_id, t.author_key, t.published_at,
      t.channel_type_value, t.channel_type_value || ' x MIXED_FOCUS' AS stratum_name, round(t.valence, 10) AS valence_score,
      'ACCEPTED' AS valence_status, CAST(t.derision_label AS VARCHAR) AS derision_label, t.derision_status
    FROM targeted t JOIN windows2 w ON published_at >= start_at AND published_at < end_at
    WHERE language_code = 'en' AND language_confidence >= 0.1 AND resolution_status = 'ACCEPTED'
      AND t.sample_type = 'CHRONOLOGICAL' AND t.exclusion_reason IS NULL""",
    "targeted windows2",
)
def _e4(spark, sf):
    out = opinion_fact(
        *canonical_tables(spark, sf),
        window_table(spark, EVENTS),
        "model_a",
        LANGUAGE_THRESHOLD,
        ["valence", "derision"],
    )
    return rounded(out, "valence_score").drop("valence_label", "derision_score")


@query(
    "j17_author_presence",
    """SELECT event_version_key, target, author_key, n_pre, n_post, round(m_pre, 10) AS mean_pre, round(m_post, 10) AS mean_post FROM presence""",
    "presence",
)
def _j17(spark, sf):
    p = author_presence(opinions(spark, sf), PRE, POST)
    return rounded(
        p.select(
            "event_version_key",
            "target",
            "author_key",
            "n_pre",
            "n_post",
            F.try_divide("s_pre", "v_pre").alias("mean_pre"),
            F.try_divide("s_post", "v_post").alias("mean_post"),
        ),
        "mean_pre",
        "mean_post",
    )


@query(
    "j18_model_pairs",
    """SELECT l_orderkey AS subject_key, max(l_linestatus) FILTER (l_returnflag = 'A') AS label_a,
      max(l_linestatus) FILTER (l_returnflag = 'R') AS label_r FROM lineitem GROUP BY ALL
    HAVING max(l_linestatus) FILTER (l_returnflag = 'A') IS NOT NULL AND max(l_linestatus) FILTER (l_returnflag = 'R') IS NOT NULL""",
)
def _j18(spark, sf):
    """Return flags as models, line status as label; both outputs of a subject meet in one aggregate."""

    def of(model):
        return F.max(F.when(F.col("l_returnflag") == model, F.col("l_linestatus")))

    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("subject_key")).agg(
        of("A").alias("label_a"), of("R").alias("label_r")
    )
    return pairs.filter("label_a IS NOT NULL AND label_r IS NOT NULL")


@query(
    "u6_unique_frame_channels",
    """SELECT l_suppkey AS frame_version_key, l_partkey AS channel_key, count(*) AS row_count FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""",
)
def _u6(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("frame_version_key"), F.col("l_partkey").alias("channel_key")
    )
    return quality.duplicate_keys(rows, ["frame_version_key", "channel_key"])


@query(
    "w6_last_engagement",
    """SELECT o_custkey AS comment_key, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS likes, max(o_orderdate) AS observed_at
    FROM orders GROUP BY ALL""",
)
def _w6(spark, sf):
    """Latest value per key as an aggregate, which combines before the shuffle."""
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("comment_key"))
        .agg(newest.alias("_s"))
        .select("comment_key", F.col("_s.o_totalprice").alias("likes"), F.col("_s.o_orderdate").alias("observed_at"))
    )


