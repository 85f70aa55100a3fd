"""Coverage metrics M001-M007 and M030, population filters, validation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import COMPLETE_SCANS

WINDOW = ("event_version_key", "window_type")


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is 0."""
    return F.try_divide(numerator, denominator)


def share_where(condition: Column, among: Column | None = None) -> Column:
    """Aggregate: share of rows fulfilling the condition, optionally among some of them."""
    if among is None:
        return ratio(F.count_if(condition), F.count(F.lit(1)))
    return ratio(F.count_if(condition & among), F.count_if(among))


def is_english(threshold: float) -> Column:
    return F.coalesce(
        (F.col("language_code") == "en") & (F.col("language_confidence") >= threshold), F.lit(False)
    )


def chronological(comments: DataFrame) -> DataFrame:
    """Primary corpus: chronological sample, not excluded by a rule."""
    return comments.filter("sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL")


def target_opinions(comments: DataFrame, language_threshold: float) -> DataFrame:
    """Analytical subset: primary corpus, English, accepted target."""
    return chronological(comments).filter(is_english(language_threshold) & (F.col("resolution_status") == "ACCEPTED"))


def methodology_coverage(
    comments: DataFrame, opinions: DataFrame, language_threshold: float, keys: Sequence[str] = WINDOW
) -> DataFrame:
    """M001, M002, M003, M004, M030 and M006 per window.

    `comments`: the retrieved corpus, one row per comment and window. `opinions`: one row
    per comment and target, with has_narrative. One pass over each, joined on the window.
    """
    retrieved = F.col("sample_type") == "CHRONOLOGICAL"
    primary = retrieved & F.col("exclusion_reason").isNull()
    english = is_english(language_threshold)
    base = comments.groupBy(*keys).agg(
        F.count_if(retrieved).alias("retrieved_canonical_count"),
        F.count_if(primary).alias("chronological_count"),
        F.count_if(primary & english).alias("english_count"),
        F.count_if(primary & english & (F.col("resolution_status") == "ACCEPTED")).alias("resolved_count"),
        F.count_if(primary & F.col("author_key").isNotNull()).alias("stable_author_count"),
    )
    subset = opinions.groupBy(*keys).agg(
        F.count_distinct("comment_key").alias("analytical_count"),
        F.count(F.lit(1)).alias("opinion_count"),
        F.count_if("has_narrative").alias("narrative_count"),
    )
    c = F.col
    return base.join(subset, list(keys), "left").fillna(0, ["analytical_count", "opinion_count", "narrative_count"]).select(
        *keys,
        "retrieved_canonical_count",
        "chronological_count",
        "english_count",
        "opinion_count",
        ratio(c("chronological_count"), c("retrieved_canonical_count")).alias("m001_corpus_retention"),
        ratio(c("analytical_count"), c("chronological_count")).alias("m030_analytical_retention"),
        ratio(c("resolved_count"), c("english_count")).alias("m002_target_resolution_rate"),
        ratio(c("english_count"), c("chronological_count")).alias("m003_language_pass_rate"),
        ratio(c("stable_author_count"), c("chronological_count")).alias("m004_author_id_coverage"),
        ratio(c("narrative_count"), c("opinion_count")).alias("m006_narrative_coverage"),
    )


def complete_window_coverage(intended: DataFrame, run_status: DataFrame) -> DataFrame:
    """M005 per window and stratum.

    `intended`: event, window, stratum, video_key. `run_status`: video_key, started_at,
    continuity_status; the latest run of a video counts.
    """
    latest = run_status.groupBy("video_key").agg(
        F.max(F.struct("started_at", "continuity_status")).getField("continuity_status").alias("continuity_status")
    )
    return (
        intended.join(latest, "video_key", "left")
        .groupBy(*WINDOW, "stratum_name")
        .agg(
            F.count(F.lit(1)).alias("intended_video_count"),
            F.count_if(F.col("continuity_status").isin(*COMPLETE_SCANS)).alias("complete_video_count"),
        )
        .withColumn(
            "m005_complete_window_coverage", ratio(F.col("complete_video_count"), F.col("intended_video_count"))
        )
    )


def classifier_coverage(opinions: DataFrame, status_columns: dict[str, str]) -> DataFrame:
    """M007 per window and construct.

    `status_columns` maps a construct to the column with its classification status; the
    constructs are unrolled after one conditional count each, not by multiplying rows.
    """
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.col(c) == "ACCEPTED").alias(f"_c{i}") for i, c in enumerate(status_columns.values())
    ]
    per_construct = F.array(
        *[
            F.struct(F.lit(name).alias("construct_key"), F.col(f"_c{i}").alias("accepted_count"))
            for i, name in enumerate(status_columns)
        ]
    )
    return (
        opinions.groupBy(*WINDOW)
        .agg(*aggs)
        .select(*WINDOW, "_n", F.explode(per_construct).alias("_x"))
        .select(
            *WINDOW,
            "_x.construct_key",
            "_x.accepted_count",
            F.col("_n").alias("opinion_count"),
            ratio(F.col("_x.accepted_count"), F.col("_n")).alias("m007_classifier_output_coverage"),
        )
    )


def volumes(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """Pure comment volume and target-specific volume per window."""
    pure = chronological(comments).groupBy(*WINDOW).agg(F.count_distinct("comment_key").alias("comment_volume"))
    target = opinions.groupBy(*WINDOW).agg(F.count_distinct("comment_key", "target").alias("target_volume"))
    return pure.join(target, list(WINDOW), "left").fillna(0, ["target_volume"])


def sample_measures(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """Counts the minimum-cohort thresholds refer to, per window."""
    base = chronological(comments).groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("comment_count"), F.count_distinct("salt_version_id", "author_key").alias("author_count")
    )
    subset = opinions.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("opinion_count"), F.count_distinct("stratum_name").alias("strata_count")
    )
    return base.join(subset, list(WINDOW), "left")


def confusion(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def validation_scores(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Support, precision, recall and F1 per class, all from the confusion matrix (classes squared)."""
    cells = confusion(pairs, truth, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
                F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
            )
        ).alias("s"),
        F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"),
    )
    classes = sides.groupBy("s.label").agg(
        F.sum("s.support").cast("bigint").alias("support"),
        F.sum("s.claimed").cast("bigint").alias("claimed"),
        (F.sum("hit") / 2).alias("hit"),
    )
    recall, precision = ratio(F.col("hit"), F.col("support")), ratio(F.col("hit"), F.col("claimed"))
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.col("support") + F.col("claimed")), F.lit(0.0))
    return classes.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def validation_summary(scores: DataFrame) -> DataFrame:
    """Macro F1 and balanced accuracy over the classes."""
    return scores.agg(
        F.count(F.lit(1)).alias("class_count"),
        F.avg("f1").alias("macro_f1"),
        F.avg("recall").alias("balanced_accuracy"),
    )


def krippendorff_alpha(ratings: DataFrame, unit: str = "unit", label: str = "label") -> DataFrame:
    """Nominal alpha over units with at least two ratings, from coincidence counts.

    Label counts per unit give the coincidences, so no pair of ratings is ever formed.
    """
    per_label = ratings.filter(F.col(label).isNotNull()).groupBy(unit, label).agg(F.count(F.lit(1)).alias("c"))
    sizes = per_label.groupBy(unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    pairable = sizes.filter("m >= 2")
    observed = pairable.agg(
        F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("disagree")
    )
    totals = (
        per_label.join(pairable.select(unit), unit, "left_semi").groupBy(label).agg(F.sum("c").alias("t"))
    ).agg(F.sum(F.col("t") * F.col("t")).alias("tsq"))
    # two one-row aggregates become one row by summing their union
    one = observed.unionByName(totals, allowMissingColumns=True).agg(
        F.sum("n").alias("n"), F.sum("disagree").alias("disagree"), F.sum("tsq").alias("tsq")
    )
    expected = (F.col("n") * F.col("n") - F.col("tsq")) / (F.col("n") - 1)
    return one.select(
        F.col("n").cast("bigint").alias("pairable_ratings"),
        (1 - ratio(F.col("disagree"), expected)).alias("krippendorff_alpha"),
    )
