"""One builder per mart, each at its declared grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.config import MinimumCohort
from eventlens.operators.cohort import cohort_gate
from eventlens.plans import authors, coverage, decomposition, narrative, reaction


def mart_methodology_coverage_event_window(
    comments: DataFrame, opinions: DataFrame, language_threshold: float
) -> DataFrame:
    return coverage.methodology_coverage(comments, opinions, language_threshold)


def mart_complete_window_coverage_stratum(intended: DataFrame, run_status: DataFrame) -> DataFrame:
    return coverage.complete_window_coverage(intended, run_status)


def mart_classifier_output_coverage(opinions: DataFrame, status_columns: dict[str, str]) -> DataFrame:
    return coverage.classifier_coverage(opinions, status_columns)


def mart_target_reaction_window(opinions: DataFrame, negative_below: float, positive_above: float) -> DataFrame:
    return reaction.target_reaction(opinions, negative_below, positive_above)


def mart_video_balanced_reaction(opinions: DataFrame) -> DataFrame:
    return reaction.video_balanced_valence(opinions)


def mart_model_comparison(inferences: DataFrame, first: str, second: str, label_map: dict[str, str] | None = None) -> DataFrame:
    keys = ("event_version_key", "window_type", "construct_key")
    return reaction.model_disagreement(inferences, first, second, label_map, keys).withColumns(
        {"first_model": F.lit(first), "second_model": F.lit(second)}
    )


def mart_author_window_activity(opinions: DataFrame) -> DataFrame:
    return authors.author_window_activity(opinions)


def mart_observed_author_overlap(opinions: DataFrame, pre: str, post: Sequence[str]) -> DataFrame:
    """M016 and M017 for the baseline against each post window, in one pass over the opinions.

    Presence in the baseline is a flag on the author row, so the window pairs are unrolled
    after the aggregation, one row per author and post window.
    """
    keys = ["event_version_key", "target"]
    counts = [F.count_if(F.col("window_type") == w).alias(f"_n{i}") for i, w in enumerate(post)]
    presence = (
        opinions.filter("author_key IS NOT NULL")
        .groupBy(*keys, "salt_version_id", "author_key")
        .agg(F.count_if(F.col("window_type") == pre).alias("n_pre"), *counts)
    )
    pairs = presence.select(
        *keys,
        "n_pre",
        F.explode(
            F.array(*[F.struct(F.lit(w).alias("post_window"), F.col(f"_n{i}").alias("n_post")) for i, w in enumerate(post)])
        ).alias("_p"),
    ).select(*keys, "n_pre", "_p.*")
    in_pre, in_post = F.col("n_pre") > 0, F.col("n_post") > 0
    new_comments = F.sum(F.when(~in_pre, F.col("n_post")).otherwise(0))
    return pairs.groupBy(*keys, "post_window").agg(
        F.lit(pre).alias("pre_window"),
        F.count_if(in_pre & in_post).alias("shared_author_count"),
        F.count_if(in_pre | in_post).alias("observed_author_count"),
        coverage.ratio(F.count_if(in_pre & in_post), F.count_if(in_pre | in_post)).alias("m016_author_overlap"),
        coverage.ratio(new_comments, F.sum("n_post")).alias("m017_new_author_contribution"),
    )


def mart_returning_author_shift(opinions: DataFrame, pre: str, post: Sequence[str]) -> DataFrame:
    """M018, one row per event, target and window pair."""
    return authors.returning_author_pairs(opinions, pre, post)


def mart_channel_shift_contribution(opinions: DataFrame, pre: str, post: Sequence[str], n_min: int | None) -> DataFrame:
    """Terms of M019 and M020, one row per event, target, window pair and stratum."""
    return decomposition.pair_contributions(opinions, pre, post, n_min)


def mart_channel_shift_decomposition(
    opinions: DataFrame, pre: str, post: Sequence[str], n_min: int | None, min_strata: int | None
) -> DataFrame:
    """M019 and M020, one row per event, target and window pair."""
    terms = decomposition.pair_contributions(opinions, pre, post, n_min)
    return decomposition.decompose_shift(terms, min_strata, (*decomposition.TARGET, *decomposition.PAIR))


def mart_stratum_adjusted_reaction(opinions: DataFrame, pre: str, post: Sequence[str], n_min: int | None) -> DataFrame:
    return decomposition.stratum_adjusted(opinions, pre, post, n_min)


def mart_narrative_window(assignments: DataFrame, opinions: DataFrame) -> DataFrame:
    return narrative.narrative_window(assignments, opinions)


def gated_reaction(
    comments: DataFrame, opinions: DataFrame, minimum: MinimumCohort, negative_below: float, positive_above: float
) -> DataFrame:
    """Target reaction with values withheld where the window misses a cohort threshold."""
    status = cohort_gate(coverage.sample_measures(comments, opinions), minimum).select(
        *coverage.WINDOW, "sample_status"
    )
    mart = mart_target_reaction_window(opinions, negative_below, positive_above).join(status, list(coverage.WINDOW))
    values = [c for c in mart.columns if c[:4] in ("m008", "m010", "m011", "m012", "m013")]
    return mart.select(
        *[
            F.when(F.col("sample_status") == "OK", F.col(c)).alias(c) if c in values else F.col(c)
            for c in mart.columns
        ]
    )
