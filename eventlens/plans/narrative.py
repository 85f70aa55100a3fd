"""Narrative metrics M022-M027 and narrative lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordered import neighbours
from eventlens.plans.coverage import ratio, share_where

INSTANCE = ("event_version_key", "target", "window_type")


def narrative_window(assignments: DataFrame, opinions: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """M022-M027 per narrative with their denominators.

    `assignments`: one row per opinion and narrative, with comment_key, is_primary, stance
    (NULL when abstained), stance_eligible (the stance model applies to it) and channel_type_value.
    A stance counts for eligible assignments only. The denominators are sums over the per-
    narrative counts, so assignments are aggregated once.
    """
    keys = list(keys)
    eligible_stance = F.coalesce(F.col("stance_eligible"), F.lit(False))
    stance = F.col("stance").isNotNull() & eligible_stance
    per_narrative = assignments.groupBy(*keys, "narrative").agg(
        F.count_if("is_primary").alias("primary_count"),
        F.count_distinct("comment_key").alias("opinion_with_instance_count"),
        F.count(F.lit(1)).alias("narrative_assignment_count"),
        F.count_if(F.col("channel_type_value") == "BROAD_REACH_PUBLISHER").alias("broad"),
        F.count_if(F.col("channel_type_value") == "UNCLASSIFIED").alias("unclassified"),
        F.count_if(stance).alias("accepted_stance_assignment_count"),
        F.count_if(eligible_stance).alias("eligible_stance_assignment_count"),
        share_where(F.col("stance") == "SUPPORTS", stance).alias("m025_support_rate"),
        share_where(F.col("stance") == "OPPOSES", stance).alias("m026_opposition_rate"),
    )
    primaries = per_narrative.groupBy(*keys).agg(F.sum("primary_count").alias("accepted_primary_narrative_count"))
    eligible = opinions.groupBy(*keys).agg(F.count_distinct("comment_key").alias("eligible_target_opinion_count"))
    c = F.col
    return (
        per_narrative.join(primaries, keys)
        .join(eligible, keys)
        .select(
            *keys,
            "narrative",
            "eligible_target_opinion_count",
            c("accepted_primary_narrative_count").cast("bigint").alias("accepted_primary_narrative_count"),
            "narrative_assignment_count",
            "accepted_stance_assignment_count",
            "eligible_stance_assignment_count",
            ratio(c("primary_count"), c("accepted_primary_narrative_count")).alias("m022_primary_share"),
            ratio(c("opinion_with_instance_count"), c("eligible_target_opinion_count")).alias("m023_multi_label_prevalence"),
            ratio(c("broad"), c("narrative_assignment_count")).alias("m024_broad_reach_share"),
            ratio(c("unclassified"), c("narrative_assignment_count")).alias("unclassified_share"),
            "m025_support_rate",
            "m026_opposition_rate",
            ratio(c("accepted_stance_assignment_count"), c("eligible_stance_assignment_count")).alias("m027_stance_coverage"),
        )
    )


def narrative_lifecycle(assignments: DataFrame, gap_days: int, hot: int | None = None) -> DataFrame:
    """First and last day, active days and reactivations per narrative.

    Assignments are folded to one row per narrative and day before days are compared.
    A reactivation is an active day after more than `gap_days` without activity.
    """
    days = assignments.groupBy("narrative", F.to_date("published_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    seen = neighbours(days, ["narrative"], [F.col("day")], before={"_prev": "day"}, hot=hot)
    pause = F.date_diff("day", "_prev")
    return seen.groupBy("narrative").agg(
        F.min("day").alias("first_seen"),
        F.max("day").alias("last_seen"),
        F.count(F.lit(1)).alias("active_days"),
        F.count_if(pause > gap_days).alias("reactivations"),
        F.coalesce(F.max(pause), F.lit(0)).cast("bigint").alias("longest_pause_days"),
        F.date_diff(F.max("day"), F.min("day")).cast("bigint").alias("span_days"),
        F.sum("n").cast("bigint").alias("assignment_count"),
    )
