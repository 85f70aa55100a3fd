"""Tone-versus-composition decomposition M019-M021 and standardised reaction M028."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.config import approved
from eventlens.plans.coverage import ratio

TARGET = ("event_version_key", "target")


def stratum_windows(
    opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET, excluded: Sequence[str] = ()
) -> DataFrame:
    """Counts and means per stratum before and after; the only pass over the opinions."""
    before, after = F.col("window_type") == pre, F.col("window_type").isin(*post)
    usable = F.col("valence").isNotNull()
    rows = opinions.filter(~F.col("stratum_name").isin(*excluded)) if excluded else opinions
    return rows.groupBy(*keys, "stratum_name").agg(
        F.count_if(before & usable).alias("n0"),
        F.count_if(after & usable).alias("n1"),
        F.avg(F.when(before, F.col("valence"))).alias("s0"),
        F.avg(F.when(after, F.col("valence"))).alias("s1"),
    )


def paired_strata(
    opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET, excluded: Sequence[str] = ()
) -> DataFrame:
    """`stratum_windows` of the baseline against each post window on its own, still one pass over the opinions.

    The pairs are unrolled after the aggregation; a stratum is in a pair if either window has a row of it.
    """
    before, usable = F.col("window_type") == pre, F.col("valence").isNotNull()
    rows = opinions.filter(~F.col("stratum_name").isin(*excluded)) if excluded else opinions
    rows = rows.filter(F.col("window_type").isin(pre, *post))

    def measures(inside, name: str) -> list:
        return [F.count_if(inside).alias(f"_c{name}"), F.count_if(inside & usable).alias(f"_n{name}"), F.avg(F.when(inside, F.col("valence"))).alias(f"_s{name}")]

    sums = measures(before, "")
    for i, window in enumerate(post):
        sums += measures(F.col("window_type") == window, str(i))
    pairs = [
        F.struct(F.lit(pre).alias("pre_window"), F.lit(w).alias("post_window"), F.col(f"_c{i}").alias("c1"), F.col(f"_n{i}").alias("n1"), F.col(f"_s{i}").alias("s1"))
        for i, w in enumerate(post)
    ]
    folded = rows.groupBy(*keys, "stratum_name").agg(*sums).withColumn("_p", F.explode(F.array(*pairs)))
    present = folded.filter((F.col("_c") > 0) | (F.col("_p.c1") > 0))
    return present.select(*keys, "_p.pre_window", "_p.post_window", "stratum_name", F.col("_n").alias("n0"), "_p.n1", F.col("_s").alias("s0"), "_p.s1")


def shift_contributions(
    opinions: DataFrame,
    pre: str,
    post: Sequence[str],
    min_count: int | None,
    keys: Sequence[str] = TARGET,
    excluded: Sequence[str] = ("UNCLASSIFIED",),
) -> DataFrame:
    """Composition and tone term of every shared stratum, all post windows taken together."""
    return weighted_terms(stratum_windows(opinions, pre, post, keys, excluded), min_count, keys)


PAIR = ("pre_window", "post_window")


def pair_contributions(
    opinions: DataFrame,
    pre: str,
    post: Sequence[str],
    min_count: int | None,
    keys: Sequence[str] = TARGET,
    excluded: Sequence[str] = ("UNCLASSIFIED",),
) -> DataFrame:
    """Composition and tone term of every shared stratum, per pair of windows."""
    return weighted_terms(paired_strata(opinions, pre, post, keys, excluded), min_count, (*keys, *PAIR))


def weighted_terms(strata: DataFrame, min_count: int | None, keys: Sequence[str]) -> DataFrame:
    """Weights and terms of strata (n0, n1, s0, s1); unpaired strata are listed with NULL terms.

    After the aggregation only one row per stratum is left, so the weights are a window over
    at most a few dozen rows per target.
    """
    minimum = approved("n_min", min_count)
    shared = (F.col("n0") >= minimum) & (F.col("n1") >= minimum)
    strata = strata.withColumn("is_shared", shared)
    group = Window.partitionBy(*keys)

    def total(n: str):
        return F.sum(F.when(F.col("is_shared"), F.col(n))).over(group)

    weighted = strata.withColumn("w0", F.when(F.col("is_shared"), F.col("n0") / total("n0"))).withColumn(
        "w1", F.when(F.col("is_shared"), F.col("n1") / total("n1"))
    )
    return weighted.withColumn(
        "composition_term", (F.col("s0") + F.col("s1")) / 2 * (F.col("w1") - F.col("w0"))
    ).withColumn("tone_term", (F.col("w0") + F.col("w1")) / 2 * (F.col("s1") - F.col("s0")))


def decompose_shift(contributions: DataFrame, min_strata: int | None, keys: Sequence[str] = TARGET) -> DataFrame:
    """M019, M020, the shared shift, coverage of both windows and the status."""
    needed = approved("min_shared_strata", min_strata)
    valid = F.col("shared_strata_count") >= needed

    def when_valid(c: str):
        return F.when(valid, F.col(c)).alias(c)

    return (
        contributions.groupBy(*keys)
        .agg(
            F.count_if("is_shared").alias("shared_strata_count"),
            F.count_if(~F.col("is_shared")).alias("unpaired_strata_count"),
            F.sum("composition_term").alias("m019_composition_effect"),
            F.sum("tone_term").alias("m020_tone_effect"),
            (F.sum(F.col("w1") * F.col("s1")) - F.sum(F.col("w0") * F.col("s0"))).alias("shared_shift"),
            ratio(F.sum(F.when(F.col("is_shared"), F.col("n0")).otherwise(0)), F.sum("n0")).alias("pre_coverage"),
            ratio(F.sum(F.when(F.col("is_shared"), F.col("n1")).otherwise(0)), F.sum("n1")).alias("post_coverage"),
        )
        .select(
            *keys,
            "shared_strata_count",
            "unpaired_strata_count",
            when_valid("m019_composition_effect"),
            when_valid("m020_tone_effect"),
            when_valid("shared_shift"),
            "pre_coverage",
            "post_coverage",
            F.when(valid, F.lit("VALID")).otherwise(F.lit("INSUFFICIENT_STRATA")).alias("decomposition_status"),
        )
    )


def stratum_adjusted(
    opinions: DataFrame, pre: str, post: Sequence[str], min_count: int | None, keys: Sequence[str] = TARGET
) -> DataFrame:
    """M021 per stratum; NULL when either window is below the minimum."""
    minimum = approved("n_min", min_count)
    enough = (F.col("n0") >= minimum) & (F.col("n1") >= minimum)
    return stratum_windows(opinions, pre, post, keys).select(
        *keys,
        "stratum_name",
        F.col("n0").alias("baseline_count"),
        F.col("n1").alias("event_count"),
        F.when(enough, F.col("s1") - F.col("s0")).alias("m021_stratum_adjusted_sentiment"),
    )


def standardised_reaction(opinions: DataFrame, history: DataFrame, event_window: str) -> DataFrame:
    """M028: event mean against the distribution of earlier window-level means.

    `history`: target, history_window, valence, opinions of the prior windows. The spread is
    the sample standard deviation over windows, never over comments.
    """
    means = history.groupBy("target", "history_window").agg(F.avg("valence").alias("m"))
    past = means.groupBy("target").agg(
        F.count("m").alias("history_window_count"), F.avg("m").alias("mu"), F.stddev_samp("m").alias("sigma")
    )
    now = (
        opinions.filter(F.col("window_type") == event_window)
        .groupBy(*TARGET)
        .agg(F.avg("valence").alias("event_mean"))
    )
    z = ratio(F.col("event_mean") - F.col("mu"), F.col("sigma"))
    return now.join(past, "target").select(
        *TARGET, "history_window_count", "event_mean", "mu", "sigma", z.alias("m028_standardised_reaction")
    )
