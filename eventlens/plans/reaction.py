"""Reaction metrics M008-M014 and same-comment, matched and surfacing comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import valence_band
from eventlens.plans.coverage import ratio, share_where

TARGET_WINDOW = ("event_version_key", "target", "window_type")


def mean_valence(opinions: DataFrame, keys: Sequence[str] = TARGET_WINDOW) -> DataFrame:
    """M008: mean over opinions."""
    return opinions.groupBy(*keys).agg(
        F.count("valence").alias("opinion_count"), F.avg("valence").alias("m008_mean_valence")
    )


def video_balanced_valence(opinions: DataFrame, keys: Sequence[str] = TARGET_WINDOW) -> DataFrame:
    """M009: mean over videos of the video's mean; the first level takes the skew out."""
    per_video = opinions.groupBy(*keys, "video_key").agg(F.avg("valence").alias("_mean"))
    return (
        per_video.filter("_mean IS NOT NULL")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("video_count"), F.avg("_mean").alias("m009_video_balanced_valence"))
    )


def valence_shares(
    opinions: DataFrame, negative_below: float, positive_above: float, keys: Sequence[str] = TARGET_WINDOW
) -> DataFrame:
    """M010: shares of the three bands."""
    band = valence_band(F.col("valence"), negative_below, positive_above)
    return opinions.groupBy(*keys).agg(
        share_where(band == "POSITIVE").alias("positive_share"),
        share_where(band == "NEUTRAL").alias("neutral_share"),
        share_where(band == "NEGATIVE").alias("negative_share"),
    )


def construct_rate(opinions: DataFrame, construct: str, name: str, keys: Sequence[str] = TARGET_WINDOW) -> DataFrame:
    """M011-M013: positive labels among accepted outputs of one construct."""
    accepted = F.col(f"{construct}_status") == "ACCEPTED"
    return opinions.groupBy(*keys).agg(
        F.count_if(accepted).alias(f"accepted_{construct}_output_count"),
        share_where(F.col(f"{construct}_label"), accepted).alias(name),
    )


def target_reaction(
    opinions: DataFrame, negative_below: float, positive_above: float, keys: Sequence[str] = TARGET_WINDOW
) -> DataFrame:
    """M008 and M010-M013 with their denominators, in one aggregation."""
    band = valence_band(F.col("valence"), negative_below, positive_above)
    aggs = [
        F.count(F.lit(1)).alias("eligible_target_opinion_count"),
        F.count("valence").alias("accepted_valence_output_count"),
        F.avg("valence").alias("m008_mean_valence"),
        share_where(band == "POSITIVE").alias("m010_positive_share"),
        share_where(band == "NEUTRAL").alias("m010_neutral_share"),
        share_where(band == "NEGATIVE").alias("m010_negative_share"),
    ]
    for construct, name in (("derision", "m011_derision_rate"), ("toxicity", "m012_toxicity_rate"), ("sarcasm", "m013_sarcasm_rate")):
        accepted = F.col(f"{construct}_status") == "ACCEPTED"
        aggs += [
            F.count_if(accepted).alias(f"accepted_{construct}_output_count"),
            share_where(F.col(f"{construct}_label"), accepted).alias(name),
        ]
    return opinions.groupBy(*keys).agg(*aggs)


def model_disagreement(
    inferences: DataFrame, first: str, second: str, label_map: dict[str, str] | None = None, keys: Sequence[str] = ("window_type", "construct_key")
) -> DataFrame:
    """M014: differing labels among subjects both models accepted.

    Both models' outputs of a subject meet in one aggregation instead of a self join. Labels
    of the second model are translated by the declared mapping.
    """
    label = F.col("predicted_label")
    if label_map:
        pairs = [F.lit(x) for kv in label_map.items() for x in kv]
        label = F.when(
            F.col("model_key") == second, F.coalesce(F.element_at(F.create_map(*pairs), label), label)
        ).otherwise(label)

    def of(model: str):
        return F.max(F.when((F.col("model_key") == model) & (F.col("classification_status") == "ACCEPTED"), label))

    both = inferences.groupBy(*keys, "subject_key").agg(of(first).alias("a"), of(second).alias("b"))
    return (
        both.filter("a IS NOT NULL AND b IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("both_accepted_count"),
            share_where(F.col("a") != F.col("b")).alias("m014_disagreement_rate"),
        )
    )


def same_comment_treatment(opinions: DataFrame, first: str, second: str, keys: Sequence[str] = ("event_version_key", "window_type")) -> DataFrame:
    """Paired valence difference of comments naming both targets."""

    def of(target: str):
        return F.max(F.when(F.col("target") == target, F.col("target_valence")))

    paired = opinions.groupBy(*keys, "comment_key").agg(of(first).alias("a"), of(second).alias("b"))
    return (
        paired.filter("a IS NOT NULL AND b IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("paired_comment_count"),
            F.avg(F.col("a") - F.col("b")).alias("mean_paired_difference"),
        )
    )


def surfacing_audit(comments: DataFrame) -> DataFrame:
    """Relevance against chronological sample on the videos that have both.

    Conditional aggregates per video find the common videos; the deltas come from the same
    per-video sums, so comments are read once.
    """
    per_video = []
    for prefix, kind in (("c", "CHRONOLOGICAL"), ("r", "RELEVANCE")):
        here = F.col("sample_type") == kind
        derision = here & (F.col("derision_status") == "ACCEPTED")
        toxicity = here & (F.col("toxicity_status") == "ACCEPTED")
        per_video += [
            F.count_if(here).alias(f"{prefix}_n"),
            F.sum(F.when(here, F.col("valence"))).alias(f"{prefix}_valence"),
            F.count_if(derision).alias(f"{prefix}_derision_n"),
            F.count_if(derision & F.col("derision_label")).alias(f"{prefix}_derision"),
            F.count_if(toxicity).alias(f"{prefix}_toxicity_n"),
            F.count_if(toxicity & F.col("toxicity_label")).alias(f"{prefix}_toxicity"),
        ]
    videos = comments.groupBy("video_key").agg(*per_video).filter("c_n > 0 AND r_n > 0")
    total = {c: F.sum(c) for c in videos.columns if c != "video_key"}

    def delta(value: str, count: str):
        return ratio(total[f"r_{value}"], total[f"r_{count}"]) - ratio(total[f"c_{value}"], total[f"c_{count}"])

    return videos.agg(
        F.count(F.lit(1)).alias("common_video_count"),
        F.sum("c_n").cast("bigint").alias("chronological_count"),
        F.sum("r_n").cast("bigint").alias("relevance_count"),
        delta("valence", "n").alias("valence_delta"),
        delta("derision", "derision_n").alias("derision_delta"),
        delta("toxicity", "toxicity_n").alias("toxicity_delta"),
    )


def author_concentration(comments: DataFrame) -> DataFrame:
    """Herfindahl index of identified authors per sample type."""
    per_author = comments.filter("author_key IS NOT NULL").groupBy("sample_type", "salt_version_id", "author_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_author.groupBy("sample_type").agg(
        (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("author_concentration")
    )


def narrative_mix_by_sample(comments: DataFrame) -> DataFrame:
    """Narrative share per sample type."""
    counts = comments.groupBy("narrative", "sample_type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("sample_type").agg(F.sum("n").alias("total"))
    return counts.join(totals, "sample_type").select(
        "sample_type", "narrative", (F.col("n") / F.col("total")).alias("narrative_share")
    )


def matched_events(metrics: DataFrame, strata: DataFrame, targets: Sequence[str], value: str) -> DataFrame:
    """Event metrics side by side per comparison stratum.

    `strata`: event_version_key, target, comparison_stratum.
    """
    columns = [
        F.avg(F.when(F.col("target") == t, F.col(value))).alias(f"{value}_{t.lower()}") for t in targets
    ]
    return (
        metrics.join(strata, ["event_version_key", "target"])
        .groupBy("comparison_stratum")
        .agg(F.count_distinct("event_version_key").alias("event_count"), *columns)
        .withColumn(
            "difference", F.col(f"{value}_{targets[0].lower()}") - F.col(f"{value}_{targets[1].lower()}")
        )
    )
