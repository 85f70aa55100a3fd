"""Mart rows with lineage, written partitioned by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventlens.config import Lineage
from eventlens.errors import GateError
from eventlens.session import scratch

LINEAGE_COLUMNS = (
    "sampling_policy_version",
    "model_bundle_version_key",
    "taxonomy_version_key",
    "threshold_config_version_key",
    "data_as_of_at",
)


def with_lineage(mart: DataFrame, lineage: Lineage) -> DataFrame:
    return mart.withColumns(
        {
            "sampling_policy_version": F.lit(lineage.sampling_policy_version),
            "model_bundle_version_key": F.lit(lineage.model_bundle_version_key),
            "taxonomy_version_key": F.lit(lineage.taxonomy_version_key),
            "threshold_config_version_key": F.lit(lineage.threshold_config_version_key),
            "data_as_of_at": F.lit(str(lineage.data_as_of_at)).cast("timestamp_ntz"),
        }
    )


def write_mart(mart: DataFrame, path: str, lineage: Lineage, mode: str = "overwrite") -> None:
    """Rewrites only the events the mart holds (dynamic partition overwrite)."""
    (
        with_lineage(mart, lineage)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_version_key")
        .parquet(path)
    )


def publish_mart(mart: DataFrame, path: str, lineage: Lineage, rules: dict[str, Column]) -> int:
    """Write a mart if every row fulfils all rules, and give its number of rows; else write nothing and name the rules.

    The rows are counted by rule while they are written to a staging folder, so a mart is computed once, and what
    is published is what was checked. A rule may look at other rows of the mart by a window; NULL is no pass.
    """
    named = {f"_rule{i}": F.coalesce(good, F.lit(False)) for i, good in enumerate(rules.values())}
    seen = Observation()
    counts = [F.count_if(~F.col(c)).alias(c) for c in named]
    checked = with_lineage(mart, lineage).withColumns(named).observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    rows = checked.drop(*named)
    staging = scratch(mart.sparkSession, "staging")
    rows.write.parquet(staging)
    found = seen.get
    broken = {rule: found[c] for rule, c in zip(rules, named) if found[c]}
    if broken:
        raise GateError("not published, rows against a rule: " + ", ".join(f"{rule} {n}" for rule, n in broken.items()))
    staged = mart.sparkSession.read.schema(rows.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_version_key").parquet(path)
    return found["rows"]
