"""Hot-group paths give the same rows as plain windows, with one group holding a third of all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.operators import cohort, completeness, history, quality
from eventlens.operators.ordered import has_hot_group, lookup, neighbours, ranked, running_before
from eventlens.plans import bootstrap, narrative


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; group 0 holds a third, groups include NULL, values repeat and are sometimes NULL."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 == 0, 0).when(i % 50 != 1, (i % 37).cast("int")).alias("g"),
        ((i * 7919) % 101).alias("t"),
        i.alias("k"),
        F.when(i % 11 != 0, (i * 31) % 17).alias("v"),
    )


def in_time():
    return [F.col("t"), F.col("k")]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_hot_group_is_noticed(skewed):
    assert has_hot_group(skewed, ["g"], 500)
    assert not has_hot_group(skewed, ["g"], 5000)


def descending():
    return [F.col("t").desc(), F.col("v").asc_nulls_last(), F.col("k").desc()]


@pytest.mark.parametrize("order", [in_time, descending])
def test_rank(skewed, order):
    order = order()
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert rows(ranked(skewed, ["g"], order, hot=10)) == rows(plain)


def test_neighbours(skewed):
    args = (["g"], in_time(), {"p": "v", "pt": "t"}, {"n": "v", "nk": "k"})
    assert rows(neighbours(skewed, *args, hot=10)) == rows(neighbours(skewed, *args))


def test_neighbours_when_slices_are_tiny(spark):
    df = spark.range(20).select(F.lit(1).alias("g"), F.col("id").alias("t"), F.col("id").alias("k"), F.col("id").alias("v"))
    args = (["g"], in_time(), {"p": "v"}, {"n": "v"})
    assert rows(neighbours(df, *args, hot=1)) == rows(neighbours(df, *args))


@pytest.mark.parametrize("agg", ["sum", "min", "max"])
def test_running(skewed, agg):
    columns = {"r": (agg, "v")}
    assert rows(running_before(skewed, ["g"], in_time(), columns, hot=10)) == rows(
        running_before(skewed, ["g"], in_time(), columns)
    )


def test_operators_agree_on_both_paths(spark, skewed):
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("t").cast("int"))
    df = skewed.withColumn("at", ts).withColumn("g", F.coalesce("g", F.lit(-1)))

    def both(fn):
        assert rows(fn(1)) == rows(fn(None))

    sliced = [rows(history.scd2_from_history(df, "g", "v", "at", "k", slice_days=days)) for days in (1, 2, 100_000)]
    assert sliced[0] == sliced[1] == sliced[2]
    both(lambda hot: history.change_only(df, "g", ["at", "k"], ["v"], hot=hot))
    scans = df.select(F.col("g").alias("scope"), F.col("t").alias("page_number"), F.col("k").alias("item_position"), F.col("at").alias("published_at"))
    both(lambda hot: completeness.publication_order(scans, hot=hot))
    versions = df.select(F.col("g").alias("c"), F.col("at").alias("valid_from"), (F.col("at") + F.make_dt_interval(F.lit(0), F.col("v").cast("int"))).alias("valid_to"), "k")
    ordered = versions.dropDuplicates(["c", "valid_from"])
    both(lambda hot: quality.overlapping_versions(ordered, "c", hot=hot))
    runs = df.select(
        F.col("g").alias("scope"),
        F.col("k").alias("run_number"),
        F.col("at").alias("oldest_observed_at"),
        (F.col("at") - F.make_dt_interval(F.lit(0), F.lit(30))).alias("committed_watermark_at"),
        F.lit("CAPPED_BEFORE_WATERMARK").alias("continuity_status"),
    )
    both(lambda hot: completeness.gap_intervals(runs, hot=hot))
    comments = df.select(
        F.col("g").alias("video_key"),
        F.lit("EVENT").alias("window_type"),
        F.col("at").alias("published_at"),
        F.col("k").alias("comment_key"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("absolute_start_at"),
    )
    assert rows(cohort.balanced_cap(comments, 7, 6, slices=3)) == rows(cohort.balanced_cap(comments, 7, 6, slices=1))
    stories = df.select(F.col("g").alias("narrative"), F.col("at").alias("published_at"))
    both(lambda hot: narrative.narrative_lifecycle(stories, 1, hot=hot))
    sums = df.groupBy("g", "t").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    both(lambda hot: bootstrap.bootstrap_ratio(sums, ["g"], "t", 5, 1, 0.9, hot=hot))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup(skewed, how):
    right = skewed.filter("g IS NOT NULL AND g <> 5").groupBy("g").agg(F.sum("v").alias("s"))
    assert rows(lookup(skewed, right, ["g"], how, hot=100)) == rows(skewed.join(right, "g", how))


@pytest.mark.parametrize("first", ["2024-01-01", "1995-01-01"])
def test_point_in_time_in_slices_is_the_plain_interval_join(skewed, first):
    from eventlens.operators import joins

    start = F.lit(first).cast("timestamp_ntz")
    facts = skewed.withColumn("at", F.when(F.col("k") % 17 != 0, start + F.make_dt_interval(F.col("t").cast("int") * 9)))
    states = facts.filter("g IS NOT NULL AND at IS NOT NULL AND k % 3 = 0").groupBy("g", "at").agg(F.max("v").alias("v"), F.max("k").alias("id"))
    versions = history.scd2_from_history(states, "g", "v", "at", "id").withColumnRenamed("v", "state")
    other = versions.withColumnsRenamed({"g": "c"}).drop("is_current")
    alive = (F.col("g") == F.col("c")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    plain = rows(facts.join(other, alive, "left").drop("c").select(*facts.columns, "valid_from", "valid_to", "state"))
    for days in (1, 90, 100_000):
        out = joins.valid_at(facts, versions, "g", "at", ["state"], slice_days=days)
        assert rows(out.select(*facts.columns, "valid_from", "valid_to", "state")) == plain


def jobs_at_build(spark, make):
    """Jobs that run while a query is built."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        make()
        return len(tracker.getJobIdsForGroup("build"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sliced_operators_run_nothing_while_they_are_built(spark, skewed):
    from eventlens.operators import joins

    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("t").cast("int"))
    df = skewed.withColumn("at", at)
    versions = history.scd2_from_history(df, "g", "v", "at", "k")
    comments = df.select(F.col("g").alias("video_key"), F.lit("W").alias("window_type"), F.col("at").alias("published_at"), F.col("k").alias("comment_key"), F.col("at").alias("absolute_start_at"))
    assert jobs_at_build(spark, lambda: history.scd2_from_history(df, "g", "v", "at", "k")) == 0
    assert jobs_at_build(spark, lambda: joins.valid_at(df, versions, "g", "at", ["v"])) == 0
    assert jobs_at_build(spark, lambda: cohort.balanced_cap(comments, 5, 6)) == 0


def test_continuity_and_title_rule_with_hot_keys(spark, skewed):
    from eventlens.operators import strata

    at = F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.col("t").cast("int"))
    items = skewed.select(
        F.coalesce("g", F.lit(-1)).alias("scope"), F.col("t").alias("page_number"), F.col("k").alias("item_position"),
        F.col("k").cast("string").alias("source_comment_id"), at.alias("published_at"),
    )
    scopes = items.select("scope").distinct()
    marks = scopes.filter("scope % 3 = 0").withColumn("committed_watermark_at", F.lit("2023-12-30").cast("timestamp_ntz"))
    scans = scopes.withColumn("more_pages", F.col("scope") % 2 == 0)
    boundary = items.join(marks, "scope").filter("published_at = committed_watermark_at").select("scope", "source_comment_id")
    plain = completeness.continuity(items, scans, marks, boundary)
    assert rows(completeness.continuity(items, scans, marks, boundary, hot=50)) == rows(plain)
    assert rows(completeness.boundary_ids(items, plain, hot=50)) == rows(completeness.boundary_ids(items, plain))
    evidence = items.select(
        F.lit("E").alias("event_version_key"), F.lit("c").alias("channel_key"), F.concat(F.lit(" T"), F.col("scope").cast("string")).alias("title"),
        F.col("source_comment_id").alias("source_id"), "published_at", F.col("item_position").alias("video_key"),
        F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("duplicate_cluster_id"), F.lit(True).alias("included_in_prevalence"),
    )
    once = strata.same_title_rule(evidence)
    assert once.filter("included_in_prevalence").count() == scopes.count()
    assert rows(strata.same_title_rule(evidence, hot=50)) == rows(once)


def test_balanced_cap_matches_brute_force(spark):
    """Round-robin over buckets, written as the loop it stands for."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    data = [(v, start + dt.timedelta(minutes=(i * 7 + v) % 2000), i * 10 + v) for v in range(3) for i in range(40)]
    df = spark.createDataFrame(data, "video_key int, published_at timestamp_ntz, comment_key int").withColumns(
        {"window_type": F.lit("W"), "absolute_start_at": F.lit("2024-01-01").cast("timestamp_ntz")}
    )
    got = {(r.video_key, r.comment_key): r.selection_rank for r in cohort.balanced_cap(df, 5, 6).collect()}
    for video in range(3):
        buckets = {}
        for _, t, k in sorted((d for d in data if d[0] == video), key=lambda d: (d[1], d[2])):
            buckets.setdefault((t - start) // dt.timedelta(hours=6), []).append(k)
        rank = 0
        while any(buckets.values()):
            for b in sorted(buckets):
                if buckets[b]:
                    rank += 1
                    assert got[(video, buckets[b].pop(0))] == rank
