"""Work that must not grow faster than its input: rows that lie by key meet without another shuffle."""

import glob
import gzip

import pytest

from eventlens.operators import ordered
from eventlens.plans.catalog import ORACLES, QUERIES, batches, incremental
from eventlens.streaming import comments
from tests.oracle import compare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_of_runs_are_counted_where_they_lie(spark, sf):
    text = plan(QUERIES["g16_run_reconciliation"](spark, sf))
    assert "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rows", [1, 5, 500])
def test_runs_reconcile_alike_at_any_size_of_a_bucket(spark, sf, oracle, monkeypatch, rows):
    monkeypatch.setattr(incremental, "ROWS_PER_BUCKET", rows)
    name = "g16_run_reconciliation"
    error, found = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None and found, error


def test_unresolved_rows_are_dealt_by_their_number_and_joined_once(spark, sf, oracle, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 500)
    name = "q8_unresolved_opinions"
    text = plan(QUERIES[name](spark, sf))
    assert "REPARTITION_BY_NUM" in text and text.count("LeftAnti") == 1 and "LeftSemi" not in text
    error, found = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None and found, error


def test_rows_of_a_hot_key_are_left_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    even, hot = spark.range(1000).withColumnRenamed("id", "k"), spark.range(1000).selectExpr("id % 2 AS k")
    assert "REPARTITION_BY_NUM" in plan(ordered.dealt(even, ["k"]))
    assert ordered.dealt(hot, ["k"]) is hot
    assert ordered.dealt(even.limit(10), ["k"]).count() == 10


@pytest.mark.parametrize("name", ["b1_cluster_bootstrap", "b2_paired_bootstrap"])
def test_draws_are_dealt_by_their_number(spark, sf, oracle, monkeypatch, name):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 20)
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf))
    error, found = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None and found, error


@pytest.mark.parametrize("keys,hot", [(100, None), (250_000, 1)])
def test_the_comment_chain_has_buckets_for_its_comments(spark, sf, oracle, monkeypatch, keys, hot):
    laid = []
    monkeypatch.setattr(batches, "KEYS_PER_BUCKET", keys)
    monkeypatch.setattr(ordered, "HOT_GROUP_ROWS", hot or ordered.HOT_GROUP_ROWS)
    monkeypatch.setattr(comments, "layouts", lambda buckets, made=comments.layouts: laid.append(buckets) or made(buckets))
    name = "x1_comment_chain"
    error, found = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None and found, error
    assert (max(laid) > 8) == (keys == 100)


def test_arriving_pages_are_compressed_and_dealt_into_files(spark, sf, monkeypatch):
    files, stream = set(), comments.page_stream

    def listed(session, path, *rest):
        files.update(glob.glob(path.removeprefix("file:") + "/part-*"))
        return stream(session, path, *rest)

    monkeypatch.setattr(batches, "PAGES_PER_FILE", 1_000)
    monkeypatch.setattr(comments, "page_stream", listed)
    QUERIES["x1_comment_chain"](spark, sf.replace("sf0.001", "sf0.01"))
    assert len(files) >= 14 and all(f.endswith(".json.gz") for f in files)
    assert max(sum(1 for _ in gzip.open(f)) for f in files) <= 1_000


@pytest.mark.parametrize("name", ["x2_continuity", "x3_watermark_advance"])
def test_no_task_keeps_the_sorted_sides_of_many_joins(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = QUERIES[name](spark, sf)
        df.collect()
        text = plan(df).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = 0
    for line in text.splitlines():  # a stage of the plan ends where an exchange begins
        joins = 0 if "Exchange" in line else joins + ("SortMergeJoin" in line)
        assert joins <= 2


def test_the_replay_has_buckets_for_its_videos(spark, sf, oracle, monkeypatch):
    laid = []
    monkeypatch.setattr(batches, "KEYS_PER_BUCKET", 25)
    tables = batches.replay.video_tables
    monkeypatch.setattr(batches.replay, "video_tables", lambda *a: laid.append(a[-1]) or tables(*a))
    name = "s7_replay_chain"
    error, found = compare(spark, oracle, name, QUERIES[name], ORACLES[name], sf)
    assert error is None and found, error
    assert laid[0] > 8
