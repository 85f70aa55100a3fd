"""Author metrics M016-M018, M029 and author activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.times import micros_between, ntz
from eventlens.plans.coverage import ratio, share_where

TARGET = ("event_version_key", "target")


def author_presence(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """One row per identified author and target: comments and valence before and after.

    Everything author-based starts from this one map-side combined aggregation. Authors are
    kept apart by salt version, since pseudonyms of different salts never compare.
    """
    before, after = F.col("window_type") == pre, F.col("window_type").isin(*post)
    return (
        opinions.filter("author_key IS NOT NULL")
        .groupBy(*keys, "salt_version_id", "author_key")
        .agg(
            F.count_if(before).alias("n_pre"),
            F.count_if(after).alias("n_post"),
            F.sum(F.when(before, F.col("valence"))).alias("s_pre"),
            F.sum(F.when(after, F.col("valence"))).alias("s_post"),
            F.count(F.when(before, F.col("valence"))).alias("v_pre"),
            F.count(F.when(after, F.col("valence"))).alias("v_post"),
        )
    )


def author_overlap(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """M016: Jaccard index of the authors of two windows."""
    p = author_presence(opinions, pre, post, keys)
    in_pre, in_post = F.col("n_pre") > 0, F.col("n_post") > 0
    return p.groupBy(*keys).agg(
        F.count_if(in_pre & in_post).alias("shared_author_count"),
        F.count_if(in_pre | in_post).alias("observed_author_count"),
        ratio(F.count_if(in_pre & in_post), F.count_if(in_pre | in_post)).alias("m016_author_overlap"),
    )


def new_author_contribution(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """M017: share of identified post comments by authors unseen before."""
    p = author_presence(opinions, pre, post, keys)
    new = F.col("n_pre") == 0
    return p.groupBy(*keys).agg(
        F.sum(F.when(new, F.col("n_post")).otherwise(0)).cast("bigint").alias("new_author_comment_count"),
        F.sum("n_post").cast("bigint").alias("identifiable_comment_count"),
        ratio(F.sum(F.when(new, F.col("n_post")).otherwise(0)), F.sum("n_post")).alias("m017_new_author_contribution"),
    )


def returning_author_deltas(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """Mean change per shared author; one pseudonym under two salts is two authors."""
    p = author_presence(opinions, pre, post, keys)
    return p.filter("v_pre > 0 AND v_post > 0").select(
        *keys, "salt_version_id", "author_key", (F.col("s_post") / F.col("v_post") - F.col("s_pre") / F.col("v_pre")).alias("delta")
    )


def returning_author_shift(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """M018: mean of the per-author changes."""
    return returning_author_deltas(opinions, pre, post, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shared_author_count"), F.avg("delta").alias("m018_returning_author_shift")
    )


def returning_author_pairs(opinions: DataFrame, pre: str, post: Sequence[str], keys: Sequence[str] = TARGET) -> DataFrame:
    """M018 of the baseline against each post window on its own, in one pass over the opinions."""
    before = F.col("window_type") == pre
    sums = [F.avg(F.when(before, F.col("valence"))).alias("_pre")]
    sums += [F.avg(F.when(F.col("window_type") == w, F.col("valence"))).alias(f"_m{i}") for i, w in enumerate(post)]
    presence = opinions.filter("author_key IS NOT NULL").groupBy(*keys, "salt_version_id", "author_key").agg(*sums)
    pairs = [F.struct(F.lit(pre).alias("pre_window"), F.lit(w).alias("post_window"), (F.col(f"_m{i}") - F.col("_pre")).alias("delta")) for i, w in enumerate(post)]
    shared = presence.filter("_pre IS NOT NULL").select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")
    return shared.filter("delta IS NOT NULL").groupBy(*keys, "pre_window", "post_window").agg(
        F.count(F.lit(1)).alias("shared_author_count"), F.avg("delta").alias("m018_returning_author_shift")
    )


def author_window_activity(opinions: DataFrame) -> DataFrame:
    """Comments, channels, mean valence and first sight per author (under its salt), target and window."""
    return (
        opinions.filter("author_key IS NOT NULL")
        .groupBy("event_version_key", "target", "salt_version_id", "author_key", "window_type")
        .agg(
            F.count_distinct("comment_key").alias("observed_comment_count"),
            F.count_distinct("channel_key").alias("observed_channel_count"),
            F.avg("valence").alias("mean_target_valence"),
            F.min("published_at").alias("first_observed_at"),
        )
    )


def cross_stratum_participation(
    activity: DataFrame, origin_strata: Sequence[str], lookback_hours: int, since: str
) -> DataFrame:
    """M029 per target stratum: newly observed authors with recent activity in an origin stratum.

    `activity`: salt_version_id, author_key, stratum_name, published_at. An author is newly observed in a
    stratum when the first activity there is at or after `since`. Prior activity is folded to
    the first and last instant per lookback-long slot; the lookback interval touches exactly
    two slots, so equality joins on (author, slot) decide it without pairing activities.
    """
    known = activity.filter("author_key IS NOT NULL")
    first = (
        known.groupBy("stratum_name", "salt_version_id", "author_key")
        .agg(F.min("published_at").alias("t0"))
        .filter(F.col("t0") >= ntz(since))
    )
    span = lookback_hours * 3_600_000_000

    def slot(c: str):
        return F.floor(micros_between(ntz("1970-01-01 00:00:00"), F.col(c)) / F.lit(span)).cast("bigint")

    slots = (
        known.filter(F.col("stratum_name").isin(*origin_strata))
        .withColumn("slot", slot("published_at"))
        .groupBy("salt_version_id", "author_key", "stratum_name", "slot")
        .agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi"))
        .withColumnRenamed("stratum_name", "origin")
    )
    probes = first.withColumn("own_slot", slot("t0")).withColumn(
        "slot", F.explode(F.array(F.col("own_slot"), F.col("own_slot") - 1))
    )
    back = F.col("t0") - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    recent = F.when(F.col("slot") == F.col("own_slot"), F.col("lo") < F.col("t0")).otherwise(F.col("hi") >= back)
    hit = F.coalesce(recent & (F.col("origin") != F.col("stratum_name")), F.lit(False))
    per_author = (
        probes.join(slots, ["salt_version_id", "author_key", "slot"], "left")
        .groupBy("stratum_name", "salt_version_id", "author_key")
        .agg(F.max(hit).alias("crossed"))
    )
    return per_author.groupBy("stratum_name").agg(
        F.count(F.lit(1)).alias("newly_observed_author_count"),
        F.count_if("crossed").alias("cross_participating_author_count"),
        share_where(F.col("crossed")).alias("m029_cross_stratum_participation"),
    )
