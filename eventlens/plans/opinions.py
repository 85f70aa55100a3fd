"""Opinion fact: canonical tables joined to one row per comment, target and window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordered import bounded
from eventlens.operators.windows import assign_windows


def opinion_fact(
    comments: DataFrame,
    text_versions: DataFrame,
    languages: DataFrame,
    targets: DataFrame,
    inferences: DataFrame,
    videos: DataFrame,
    snapshots: DataFrame,
    windows: DataFrame,
    resolution_model: str,
    language_threshold: float,
    constructs: Sequence[str],
) -> DataFrame:
    """Accepted, English, in-window opinions with one column pair per construct.

    Only chronologically sampled comments that no rule excludes; authors keep their salt version.
    Pins the latest text version and one resolution model. Facts join on the text version
    or comment key (evenly spread); dimensions join as small sides. Long-form inferences are
    folded per subject before the join, so the fact is not multiplied.
    """
    latest = text_versions.filter("is_latest_version").select("comment_key", "text_version_key")
    english = languages.filter(
        (F.col("language_code") == "en")
        & (F.col("confidence") >= language_threshold)
        & (F.col("classification_status") == "ACCEPTED")
    ).select("text_version_key")
    accepted = targets.filter(
        (F.col("target_resolution_model_version_key") == resolution_model)
        & (F.col("classification_status") == "ACCEPTED")
    ).select("text_version_key", "comment_target_key", F.col("target_entity_key").alias("target"))
    per_subject = (
        inferences.filter(F.col("construct_key").isin(*constructs))
        .groupBy(F.col("subject_key").alias("comment_target_key"))
        .agg(
            *[
                F.max(F.when(F.col("construct_key") == c, F.struct("processed_at", "predicted_label", "score", "classification_status"))).alias(f"_{c}")
                for c in constructs
            ]
        )
    )
    population = comments.filter("sample_type = 'CHRONOLOGICAL' AND exclusion_reason IS NULL")
    placed = assign_windows(population, windows).select(
        "comment_key", "video_key", "salt_version_id", "author_key", "published_at", "event_version_key", "window_type"
    )
    out = (
        placed.join(latest, "comment_key")
        .join(english, "text_version_key", "left_semi")
        .join(accepted, "text_version_key")
        .join(per_subject, "comment_target_key", "left")
        .join(bounded(videos.select("video_key", "channel_key")), "video_key", "left")
        .join(
            bounded(snapshots.select("event_version_key", "channel_key", "channel_type_value", "focus_value")),
            ["event_version_key", "channel_key"],
            "left",
        )
    )
    columns = [
        "event_version_key", "window_type", "comment_key", "target", "video_key", "channel_key", "salt_version_id", "author_key", "published_at",
    ]
    return out.select(
        *columns,
        F.coalesce("channel_type_value", F.lit("UNCLASSIFIED")).alias("channel_type_value"),
        F.coalesce(F.concat_ws(" x ", "channel_type_value", "focus_value"), F.lit("UNCLASSIFIED")).alias("stratum_name"),
        *[
            x
            for c in constructs
            for x in (
                F.col(f"_{c}.predicted_label").alias(f"{c}_label"),
                F.col(f"_{c}.score").alias(f"{c}_score"),
                F.coalesce(F.col(f"_{c}.classification_status"), F.lit("MISSING")).alias(f"{c}_status"),
            )
        ],
    )
