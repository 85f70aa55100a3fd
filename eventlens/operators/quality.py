"""Data-quality rules. Each returns the violating rows; an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.config import CAPPED_SCANS
from eventlens.errors import GateError
from eventlens.functions.text import span_is_inside
from eventlens.operators.joins import missing_from
from eventlens.operators.ordered import bounded, neighbours


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def additivity_residuals(decomposition: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Valid decompositions whose two effects do not add up to the shared shift."""
    residual = F.abs(F.col("m019_composition_effect") + F.col("m020_tone_effect") - F.col("shared_shift"))
    return (
        decomposition.filter("decomposition_status = 'VALID'")
        .withColumn("residual", residual)
        .filter(F.col("residual") > tolerance)
    )


def engagement_conservation(comments: DataFrame, allocated: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Source and allocated likes when they differ; only comments with a target count."""
    both = (
        comments.select(F.col("likes").cast("double").alias("source"), F.lit(0.0).alias("allocated"))
        .unionByName(allocated.select(F.lit(0.0).alias("source"), F.col("fractional_likes").alias("allocated")))
        .agg(F.sum("source").alias("source_likes"), F.sum("allocated").alias("allocated_likes"))
    )
    return both.withColumn("residual", F.abs(F.col("source_likes") - F.col("allocated_likes"))).filter(
        F.col("residual") > tolerance
    )


def foreign_samples(rows: DataFrame) -> DataFrame:
    """Rows of a primary mart that do not come from the chronological sample."""
    return rows.filter(~F.col("sample_type").eqNullSafe("CHRONOLOGICAL"))


def unresolved(rows: DataFrame, bridge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a counterpart in the bridge."""
    return rows.join(bridge.select(*keys), list(keys), "left_anti").select(*rows.columns)


def capped_runs(runs: DataFrame, comment_cap: int, page_cap: int) -> DataFrame:
    return runs.filter((F.col("records_observed") > comment_cap) | (F.col("pages_requested") > page_cap))


def false_completions(runs: DataFrame) -> DataFrame:
    """Runs labelled complete although the watermark was not reached; NULL means there was none."""
    return runs.filter("continuity_status = 'COMPLETE_TO_WATERMARK' AND watermark_reached = false")


def not_exactly_one(rows: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Keys whose flagged row count is not one."""
    return rows.groupBy(*keys).agg(F.count_if(flag).alias("flagged_count")).filter("flagged_count <> 1")


def more_than_one(rows: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(flag).alias("flagged_count")).filter("flagged_count > 1")


def primary_missing_or_repeated(rows: DataFrame, keys: Sequence[str], primary: Column, accepted: Column) -> DataFrame:
    """Keys with an accepted primary where the number of primaries is not exactly one."""
    return (
        rows.groupBy(*keys)
        .agg(F.count_if(primary & accepted).alias("accepted_primary_count"), F.count_if(primary).alias("primary_count"))
        .filter("accepted_primary_count > 0 AND primary_count <> 1")
    )


def overlapping_versions(versions: DataFrame, key: str, hot: int | None = None) -> DataFrame:
    """Versions whose interval runs into the next one of the same key."""
    order = [F.col("valid_from"), F.col("valid_to").asc_nulls_last()]
    seen = neighbours(versions, [key], order, after={"next_from": "valid_from"}, hot=hot)
    return seen.filter(
        F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("next_from") < F.col("valid_to")))
    )


def spans_outside(spans: DataFrame) -> DataFrame:
    inside = span_is_inside(F.col("evidence_start"), F.col("evidence_end"), F.col("text"))
    return spans.filter(~F.coalesce(inside, F.lit(False)))


def mixed_versions(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Groups mixing several versions of a model or salt."""
    return rows.groupBy(*keys).agg(F.count_distinct(version).alias("version_count")).filter("version_count > 1")


def incompatible_constructs(inferences: DataFrame, allowed: DataFrame) -> DataFrame:
    """Inferences whose (construct, model task, subject type) is not on the allow-list."""
    keys = ["construct_key", "model_task", "subject_type"]
    return inferences.select(*keys).distinct().join(allowed.select(*keys), keys, "left_anti")


def shares_not_one(rows: DataFrame, keys: Sequence[str], share: Column, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose shares exist but do not sum to one."""
    return (
        rows.groupBy(*keys)
        .agg(F.sum(share).alias("share_sum"))
        .filter(F.col("share_sum").isNotNull() & (F.abs(F.col("share_sum") - 1) > tolerance))
    )


def out_of_bounds(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with any listed column outside its closed interval."""
    bad = F.lit(False)
    for column, (lo, hi) in bounds.items():
        bad = bad | F.coalesce(~F.col(column).between(lo, hi), F.lit(False))
    return rows.filter(bad)


def shown_below_threshold(metrics: DataFrame, value: str) -> DataFrame:
    """Metric values published although their sample is insufficient."""
    return metrics.filter((F.col("sample_status") == "INSUFFICIENT_SAMPLE") & F.col(value).isNotNull())


def untraceable(comments: DataFrame, observations: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """Comments without an observation on a landed page."""
    traced = observations.filter("source_item_position IS NOT NULL").join(
        raw_pages.select("raw_response_id").distinct(), "raw_response_id", "left_semi"
    )
    return missing_from(comments.select("comment_key"), traced, ["comment_key"])


def pilot_rows_in_research(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Research rows that came through a pilot or unknown frame."""
    purpose = frames.select("frame_version_key", "frame_purpose")
    bad = F.coalesce(F.col("frame_purpose") == "PIPELINE_PILOT", F.lit(True))
    return rows.filter("run_purpose = 'RESEARCH'").join(purpose, "frame_version_key", "left").filter(bad)


def leaked_evidence(evidence: DataFrame, periods: DataFrame) -> DataFrame:
    """Evidence published at or after the end of its reference period."""
    ends = periods.select("event_version_key", F.col("reference_period_end").alias("_end"))
    joined = evidence.join(bounded(ends), "event_version_key")
    return joined.filter(F.col("published_at") >= F.col("_end")).drop("_end")


def capped_but_advanced(states: DataFrame) -> DataFrame:
    return states.filter(F.col("continuity_status").isin(*CAPPED_SCANS) & F.col("watermark_advanced"))


def unapproved_parameters(parameters: DataFrame) -> DataFrame:
    """Parameters in use without approval; `assert_empty` on them stops a run."""
    return parameters.filter(~F.col("status").eqNullSafe("APPROVED"))


def assert_empty(violations: DataFrame, rule: str) -> None:
    """Fail closed, naming the first few violating rows."""
    found = violations.limit(5).collect()
    if found:
        raise GateError(f"{rule}: {[r.asDict() for r in found]}")
