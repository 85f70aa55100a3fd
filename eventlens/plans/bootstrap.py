"""Cluster bootstrap: intervals that respect clustering by video or author."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators import ordered
from eventlens.operators.ordered import ranked
from eventlens.plans.coverage import ratio
from eventlens.session import durable


def uniform(seed: int, *parts: Column) -> Column:
    """Deterministic draw in [0, 1) with 52 bits of a hash; a lost executor draws the same again."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def clusters(rows: DataFrame, keys: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Sum and count per cluster; replicates never touch single observations again."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(
        F.sum(value).alias("num"), F.count(F.lit(1)).cast("double").alias("den")
    )


def bootstrap_ratio(
    cluster_sums: DataFrame,
    keys: Sequence[str],
    cluster: str,
    replicates: int,
    seed: int,
    level: float,
    hot: int | None = None,
) -> DataFrame:
    """Percentile interval of sum(num)/sum(den), resampling whole clusters.

    A group of n clusters draws n per replicate. Draws are generated from the clusters
    themselves, dealt on the index they draw, folded there to a multiplicity per (replicate, cluster index), and joined
    on the index; both sides of that join are spread evenly, since indexes are dense and draws are
    uniform. There are as many partitions as the draws need, so no task grows with the number of clusters.
    """
    keys = list(keys)
    cluster_sums = durable(cluster_sums)
    n = cluster_sums.count()
    parts = max(int(cluster_sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * replicates // ordered.ROWS_PER_TASK))
    hot = ordered.ROWS_PER_TASK if hot is None else hot
    numbered = ranked(cluster_sums, keys, [F.col(cluster)], "_i", hot).withColumn("_i", F.col("_i") - 1)
    sizes = cluster_sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    indexed = numbered.join(sizes, keys)
    draws = indexed.select(
        *keys, "_n", F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r")
    ).select(
        *keys,
        "_r",
        F.floor(uniform(seed, *[F.col(k) for k in keys], F.col("_r"), F.col("_j")) * F.col("_n"))
        .cast("bigint")
        .alias("_i"),
    )
    if n * replicates > ordered.ROWS_PER_TASK:
        draws = draws.repartition(parts, *keys, "_i")
    weights = draws.groupBy(*keys, "_r", "_i").agg(F.count(F.lit(1)).alias("_w"))
    estimates = (
        weights.join(indexed, [*keys, "_i"])
        .groupBy(*keys, "_r")
        .agg(ratio(F.sum(F.col("_w") * F.col("num")), F.sum(F.col("_w") * F.col("den"))).alias("_est"))
    )
    tail = (1 - level) / 2
    point = cluster_sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cluster_count"), ratio(F.sum("num"), F.sum("den")).alias("estimate")
    )
    interval = estimates.groupBy(*keys).agg(
        F.percentile("_est", F.lit(tail)).alias("ci_low"), F.percentile("_est", F.lit(1 - tail)).alias("ci_high")
    )
    return point.join(interval, keys)


def paired_bootstrap(
    deltas: DataFrame, keys: Sequence[str], author: str, replicates: int, seed: int, level: float, hot: int | None = None
) -> DataFrame:
    """Interval of the mean per-author change; a drawn author brings all of its observations.

    Authors are drawn by salt and pseudonym, so their order is total over several salts.
    """
    who = F.struct("salt_version_id", author).alias("_author")
    sums = deltas.select(*keys, who, F.col("delta").alias("num"), F.lit(1.0).alias("den"))
    return bootstrap_ratio(sums, keys, "_author", replicates, seed, level, hot)
