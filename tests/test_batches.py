"""Batch tables and the comment chain: all or nothing, once, and only what was touched."""

import glob
import json
import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from eventlens.errors import GateError
from eventlens.functions.times import ntz
from eventlens.operators import history, joins
from eventlens.session import shared_dir
from eventlens.sources.batches import Batch, BatchTables, Layout
from eventlens.streaming import comments


def prefix():
    return f"t{uuid.uuid4().hex}"


@pytest.fixture
def kv(spark, tmp_path):
    return BatchTables(spark, str(tmp_path / "kv"), {"kv": Layout("k bigint, v string", ("k",), 64), "log": Layout("k bigint, a array<struct<x:int,y:string>>")}, prefix())


def put(stored, incoming):
    return joins.upsert(stored, incoming, ["k"], ["v"])


def files(tmp_path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/kv/kv/**/*.parquet", recursive=True)}


def test_a_merge_rewrites_touched_buckets_only(spark, kv, tmp_path):
    with kv.batch(0) as batch:
        batch.merge("kv", spark.range(1000).selectExpr("id AS k", "'old' AS v"), put)
    before = files(tmp_path)
    with kv.batch(1) as batch:
        batch.merge("kv", spark.range(10).selectExpr("id * 100 AS k", "'new' AS v"), put)
    after = files(tmp_path)
    assert all(after[f] == before[f] for f in before)
    touched = {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}
    assert len(before) == 64 and 0 < len(touched) <= 10
    got = {r.k: r.v for r in kv.live("kv").collect()}
    assert got == {k: "new" if k % 100 == 0 else "old" for k in range(1000)}


@pytest.mark.parametrize("rule", ["upsert", "scd2"])
def test_the_stored_side_is_not_shuffled(spark, kv, tmp_path, rule):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if rule == "upsert":
            with kv.batch(0) as batch:
                batch.merge("kv", spark.range(100).selectExpr("id AS k", "'old' AS v"), put)
            plan = put(kv.live("kv", [1, 2, 3]), spark.range(10).selectExpr("id AS k", "'new' AS v"))
        else:
            columns = "k bigint, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
            tables = BatchTables(spark, str(tmp_path / "scd"), {"v": Layout(columns, ("k",), 16)}, prefix())
            rows = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"), ntz("2020-01-01 00:00:00").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
            with tables.batch(0) as batch:
                batch.load("v", rows)
            new = spark.range(10).selectExpr("id AS k", "'b' AS v")
            plan = history.scd2_merge(tables.live("v"), new, ["k"], ["v"], ntz("2024-01-01 00:00:00"))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_rows_count_from_the_marker_on(spark, kv):
    kv.batch(0).append("log", spark.range(3).selectExpr("id AS k", "array(named_struct('x', 1, 'y', 'b')) AS a"))
    assert kv.live("log").count() == 0
    with kv.batch(0) as batch:
        written = batch.append("log", spark.range(2).selectExpr("id AS k", "array(named_struct('x', 1, 'y', 'b')) AS a"))
        assert written.count() == 2
        with pytest.raises(GateError):
            batch.append("log", written)
    assert sorted(r.k for r in kv.live("log").collect()) == [0, 1]
    with pytest.raises(GateError):
        kv.batch(0)


def test_a_later_application_finds_the_tables(spark, kv):
    with kv.batch(0) as batch:
        batch.merge("kv", spark.range(20).selectExpr("id AS k", "'a' AS v"), put)
    again = BatchTables(spark, kv.root, kv.layouts, prefix())
    assert again.live("kv").count() == 20
    with again.batch(1) as batch:
        batch.merge("kv", spark.range(30).selectExpr("id AS k", "'b' AS v"), put)
    assert {r.v for r in again.live("kv").collect()} == {"b"} and again.live("kv").count() == 30


def test_superseded_batches_are_removed(spark, kv, tmp_path):
    for number in range(3):
        with kv.batch(number) as batch:
            batch.merge("kv", spark.range(500).selectExpr("id AS k", f"'{number}' AS v"), put)
    assert kv.drop_superseded("kv") == [0, 1]
    assert {f.split("batch_id=")[1].split("/")[0] for f in files(tmp_path)} == {"2"}
    assert kv.live("kv").groupBy("v").count().collect()[0]["count"] == 500


# ------------------------------------------------------------------ the chain


def page(run, number, items):
    item = lambda cid, at, text, likes: {
        "id": cid,
        "snippet": {"totalReplyCount": 0, "topLevelComment": {"snippet": {"publishedAt": at, "textOriginal": text, "likeCount": likes, "authorChannelId": {"value": "a"}}}},
    }
    return {
        "resource_scope_id": f"v{number % 3}",
        "request_parameters": "{}",
        "http_status": 200,
        "retrieved_at": f"2024-02-0{run}T00:{number:02}:00.000001",
        "raw_json_payload": json.dumps({"items": [item(*i) for i in items]}),
    }


def arrive(folder, run, seed):
    """Pages of a run: comments overlap with the other runs, some are edited or liked, some are malformed."""
    rnd = random.Random(seed)
    os.makedirs(folder, exist_ok=True)
    for number in range(6):
        items = []
        for _ in range(rnd.randint(0, 6)):
            cid = rnd.choice([None, *[f"c{i}" for i in range(12)]])
            items.append((cid, rnd.choice(["2024-01-01T00:00:00Z"] * 6 + ["never"]), rnd.choice(["x", "y", "z"]), rnd.randint(0, 1)))
        with open(f"{folder}/run{run}-{number}.json", "w") as out:
            out.write(json.dumps(page(run, number, items)))


def run_chain(tables, folder, run):
    comments.ingest_pages(tables, folder, f"{tables.root}-state", f"run{run}", "CHRONOLOGICAL", {"s1": b"pepper"}, "s1", max_files=2)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def batch_result(tables):
    """The batch operators over all landed pages."""
    runs = {r[0] for r in tables.live("raw_page").select("ingestion_run_id").distinct().collect()}
    assert runs
    items = comments.parsed(tables.live("raw_page"), "CHRONOLOGICAL", {"s1": b"pepper"}, "s1")
    good = items.filter("error_code IS NULL")
    order = ["observed_at", "raw_response_id", "item_position"]
    changed = history.change_only(good, "source_comment_id", order, ["likes", "reply_count"])
    return {
        "comment": plain(history.canonical_comments(good)),
        "text": plain(history.text_versions(good)),
        "engagement": plain(changed.select("source_comment_id", *order, "likes", "reply_count", "ingestion_run_id")),
        "sample": plain(history.sample_observations(good)),
        "dead": plain(items.filter("error_code IS NOT NULL").select("source_comment_id", "raw_response_id", "item_position", "observed_at", "error_code")),
    }


def chain_result(tables):
    versions = comments.text_versions(tables).select("source_comment_id", "text_hash", "observed_at", "is_latest_version")
    return {
        "comment": plain(comments.comments(tables)),
        "text": plain(versions),
        "engagement": plain(tables.live("engagement")),
        "sample": plain(tables.live("sample_observation")),
        "dead": plain(tables.live("dead_letter")),
    }


def test_a_chain_that_fails_between_two_tables_leaves_each_row_once(spark, tmp_path, monkeypatch):
    tables = comments.comment_tables(spark, str(tmp_path / "tables"), prefix(), buckets=4)
    folder = str(tmp_path / "arrived")
    arrive(folder, 1, seed=1)
    merge, failures = Batch.merge, []

    def breaks(self, name, incoming, rule):
        if name == "comment" and self.batch_id == 1 and len(failures) < 2:
            failures.append(name)
            raise RuntimeError("executor lost")
        merge(self, name, incoming, rule)

    monkeypatch.setattr(Batch, "merge", breaks)
    for attempt in range(3):
        try:
            run_chain(tables, folder, 1)
            break
        except Exception:
            # the first batch counts, the broken one doesn't, though it has written four tables
            assert {r.batch_id for r in tables.markers().collect()} == {0}
            assert chain_result(tables) == batch_result(tables)
    assert len(failures) == 2
    assert chain_result(tables) == batch_result(tables)

    arrive(folder, 2, seed=2)
    run_chain(tables, folder, 2)
    assert {r[0] for r in tables.live("raw_page").select("ingestion_run_id").distinct().collect()} == {"run1", "run2"}
    assert chain_result(tables) == batch_result(tables)
    before = chain_result(tables)
    run_chain(tables, folder, 3)  # nothing has arrived
    assert chain_result(tables) == before


def test_a_chain_keeps_on_disk_what_is_live_only(spark, tmp_path):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(local.getAllFiles())) if name.startswith("shuffle_")}
    rows = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/rows-*"))
    before = shuffled(), rows()
    tables = comments.comment_tables(spark, str(tmp_path / "tables"), prefix(), buckets=4)
    folder = str(tmp_path / "arrived")
    for run in (1, 2):
        arrive(folder, run, seed=run)
        for number in range(6):  # in this order, so that no snapshot is late
            os.utime(f"{folder}/run{run}-{number}.json", (1_700_000_000 + 10 * run + number,) * 2)
        run_chain(tables, folder, run)
    end = time.time() + 20
    while shuffled() - before[0] and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before[0] and rows() == before[1]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    marked = {(r.table_name, r.batch_id, b) for r in tables.markers().collect() for b in r.buckets}
    last = {(name, bucket): max(b for n, b, k in marked if (n, k) == (name, bucket)) for name, _, bucket in marked}
    found = {name: glob.glob(f"{tables.root}/{name}/**/*.parquet", recursive=True) for name in tables.layouts}
    for name in ("comment", "text_version"):
        kept = {int(f.split("batch_id=")[1].split("/")[0]) for f in found[name]}
        assert kept == {batch for (n, _), batch in last.items() if n == name}
    assert not found["snapshot"] and found["raw_page"] and all(f.endswith(".zstd.parquet") for files in found.values() for f in files)
    assert chain_result(tables) == batch_result(tables)


def test_a_snapshot_before_the_stored_one_is_a_dead_letter(spark):
    columns = "id string, at bigint, v int"
    stored = spark.createDataFrame([("a", 5, 1)], columns)
    new = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("a", 6, 1), ("a", 7, 2), ("b", 1, 9), ("b", 2, 9)], columns)
    changes, late, last = history.changes_since(stored, new, "id", ["at"], ["v"])
    assert plain(changes) == [("a", 7, 2), ("b", 1, 9)]
    assert plain(late) == [("a", 4, 2), ("a", 5, 1)]
    assert plain(last) == [("a", 7, 2), ("b", 2, 9)]


def test_folded_states_equal_the_state_of_all_attempts(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.randint(0, 9), i, rnd.choice(["RESOLVED", "PARSE_ERROR"]), rnd.choice([None, "E"]), rnd.randint(0, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id int, attempted_at int, attempt_id int, status string, error_code string, retry_count int")
    df = df.withColumn("attempted_at", F.timestamp_add("SECOND", F.col("attempted_at"), ntz("2024-01-01 00:00:00")))
    state = lambda part: history.resolution_state(part, with_attempt=True)
    folded = state(df.filter("attempt_id % 3 = 2"))
    for part in (0, 1):
        folded = history.fold_resolution(folded, state(df.filter(f"attempt_id % 3 = {part}")))
    assert plain(folded.select(*state(df).columns)) == plain(state(df))
