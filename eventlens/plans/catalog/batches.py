"""Tables kept up to date batch by batch: the comment chain, and merges that rewrite touched buckets only."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.functions.times import ntz
from eventlens.operators import history, joins
from eventlens.plans.catalog.base import ORACLES, query, table
from eventlens.plans.catalog.history import part_prices, segment_versions, unit_attempts, video_attempts
from eventlens.plans.catalog.joins import customer_balances
from eventlens.plans.catalog.sources import comment_page_rows, video_pages
from eventlens.session import scratch
from eventlens.sources import landing, replay
from eventlens.sources.batches import BatchTables, Layout
from eventlens.streaming import comments, continuity

BUCKETS = 8

#: Keys that a bucket holds at most, or so; tables of more have more buckets.
KEYS_PER_BUCKET = 250_000

#: Pages in one file of arriving pages at most: a compressed file is read by one task.
PAGES_PER_FILE = 50_000


def buckets_for(keys):
    return max(BUCKETS, -(-keys // KEYS_PER_BUCKET))


def _tables(spark, layouts):
    return BatchTables(spark, scratch(spark, "batches"), layouts, f"q{uuid.uuid4().hex}")


# ------------------------------------------------------------------ comment chain
# Pages arrive in two runs. The first one misses every seventh page; the second one reads those and, again, every other
# page a day later, with edits and more likes.

_ARRIVED = """WITH pages AS (SELECT *, r, ts + to_days(r) AS seen FROM events, (VALUES (1), (2)) v(r)
    WHERE CASE r WHEN 1 THEN event_id % 7 <> 0 ELSE event_id % 7 = 0 OR event_id % 2 = 0 END),
  items AS (
    SELECT CASE WHEN event_id % 97 <> 0 THEN 'c' || event_id END AS id, CASE WHEN event_id % 89 <> 0 THEN ts END AS published_at, 0 AS pos,
      event_type || CASE WHEN r = 2 AND event_id % 5 = 0 THEN ' edited' ELSE '' END AS text, r, seen, json_extract_string(props, '$.k') AS video,
      CAST(floor(value) AS BIGINT) + CASE WHEN r = 2 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS likes, event_id % 4 AS replies FROM pages
    UNION ALL SELECT 'd' || event_id, ts, 1, '', r, seen, json_extract_string(props, '$.k'), 0, 0 FROM pages),
  good AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen) AS n, lag((likes, replies)) OVER (PARTITION BY id ORDER BY seen) AS before
    FROM items WHERE id IS NOT NULL AND published_at IS NOT NULL),
  texts AS (SELECT id, sha256(text) AS hash, min(seen) AS seen, max(seen) AS last FROM good GROUP BY ALL)"""


def _line(*parts: str) -> str:
    return " || '|' || ".join(parts)


@query(
    "x1_comment_chain",
    f"""{_ARRIVED}
    SELECT 'raw_page' AS table_name, json_extract_string(props, '$.k') AS id, epoch_us(seen)::VARCHAR AS detail FROM pages
    UNION ALL SELECT 'dead_letter', coalesce(id, ''), {_line("CASE WHEN id IS NULL THEN 'MISSING_ID' ELSE 'BAD_TIMESTAMP' END", "epoch_us(seen)", "pos")}
      FROM items WHERE id IS NULL OR published_at IS NULL
    UNION ALL SELECT 'comment', id, {_line("any_value(video)", "epoch_us(min(published_at))", "epoch_us(min(seen))", "count(*) - 1")} FROM good GROUP BY id
    UNION ALL SELECT 'text_version', id, {_line("hash", "epoch_us(seen)", "epoch_us(last)", "CASE WHEN last = max(last) OVER (PARTITION BY id) THEN 1 ELSE 0 END")} FROM texts
    UNION ALL SELECT 'engagement', id, {_line("epoch_us(seen)", "likes", "replies", "'run' || r")} FROM good WHERE before IS DISTINCT FROM (likes, replies)
    UNION ALL SELECT 'sample', regexp_replace(md5(id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5'), {_line("pos", "'CHRONOLOGICAL'", "epoch_us(seen)")} FROM good""",
)
def _x1_chain(spark, sf):
    """Two runs of page files through the chain, in several micro-batches; all tables, a text line for each row."""
    events = table(spark, sf, "events").count()
    buckets = buckets_for(2 * events)  # two comments to a page
    in_file = max(1_000, min(PAGES_PER_FILE, events // (4 * spark.sparkContext.defaultParallelism)))
    written = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "compression": "gzip", "maxRecordsPerFile": in_file}
    tables = comments.comment_tables(spark, scratch(spark, "comments"), f"q{uuid.uuid4().hex}", buckets)
    arrived = scratch(spark, "arrived")
    e = F.col("event_id")
    for run, wanted in ((1, e % 7 != 0), (2, (e % 7 == 0) | (e % 2 == 0))):
        pages = comment_page_rows(spark, sf, run).filter(wanted)
        pages.drop("event_id").write.options(**written).json(f"{arrived}/run{run}")
        comments.ingest_pages(tables, f"{arrived}/*", f"{tables.root}-state", f"run{run}", "CHRONOLOGICAL", {"s1": b"pepper"}, "s1")
    return chain_rows(tables)


def chain_rows(tables):
    """(table_name, id, detail) of every row of the chain's tables."""

    def rows(name, frame, key, *parts):
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c.endswith("_at") else F.col(c)
        return frame.select(F.lit(name).alias("table_name"), key.alias("id"), F.concat_ws("|", *[micros(p).cast("string") for p in parts]).alias("detail"))

    cid = F.col("source_comment_id")
    live = tables.live
    found = [
        rows("raw_page", live("raw_page"), F.col("resource_scope_id"), "retrieved_at"),
        rows("dead_letter", live("dead_letter"), F.coalesce(cid, F.lit("")), "error_code", "observed_at", "item_position"),
        rows("comment", comments.comments(tables), cid, "video_key", "published_at", "first_observed_at", "duplicate_observations"),
        rows("text_version", comments.text_versions(tables).withColumn("latest", F.col("is_latest_version").cast("int")), cid, "text_hash", "observed_at", "last_observed_at", "latest"),
        rows("engagement", live("engagement"), cid, "observed_at", "likes", "reply_count", "ingestion_run_id"),
        rows("sample", live("sample_observation"), F.col("comment_key"), "source_item_position", "sample_type", "observed_at"),
    ]
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


# ------------------------------------------------------------------ merges of touched buckets


def _ddl(df) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _upserted(spark, name, stored, changes, key, columns):
    """The stored version as one batch, the changes as a second one."""
    tables = _tables(spark, {name: Layout(_ddl(stored), (key,), BUCKETS)})
    for number, rows in enumerate((stored, changes)):
        with tables.batch(number) as batch:
            batch.merge(name, rows, lambda old, new: joins.upsert(old, new, [key], columns))
    return tables.live(name)


@query("t4_bucketed_upsert", ORACLES["t4_merge_update_insert"])
def _t4_buckets(spark, sf):
    return _upserted(spark, "part", *part_prices(spark, sf), "p_partkey", ["label", "price"])


@query("j9_bucketed_upsert", ORACLES["j9_upsert"])
def _j9_buckets(spark, sf):
    return _upserted(spark, "customer", *customer_balances(spark, sf), "c_custkey", ["segment", "balance"])


@query("t1_bucketed_scd2", ORACLES["t1_scd2_merge"])
def _t1_buckets(spark, sf):
    stored, incoming = segment_versions(spark, sf)
    tables = _tables(spark, {"segment": Layout(_ddl(stored), ("c_custkey",), BUCKETS)})
    with tables.batch(0) as batch:
        batch.load("segment", stored)
    with tables.batch(1) as batch:
        rule = lambda old, new: history.scd2_merge(old, new, ["c_custkey"], ["terms"], ntz("2024-01-01 00:00:00"), term_lists=["terms"])
        batch.merge("segment", incoming, rule)
    return tables.live("segment").withColumn("segment", F.get("terms", F.lit(0))).drop("terms")


def _in_batches(spark, name, attempts, keys, state, fold):
    """Attempts in three batches, the late ones not last, folded into one state table."""
    tables = _tables(spark, {name: Layout(_ddl(state(attempts)), keys, BUCKETS)})
    for number, part in enumerate((1, 2, 0)):
        with tables.batch(number) as batch:
            batch.merge(name, state(attempts.filter(F.col("attempt_id") % 3 == part)), fold)
    return tables.live(name).drop("last_attempt_id")


@query("t17_folded_resolution", ORACLES["t17_resolution_state"])
def _t17_buckets(spark, sf):
    state = lambda rows: history.resolution_state(rows, with_attempt=True)
    return _in_batches(spark, "resolution", video_attempts(spark, sf), ("source_id",), state, history.fold_resolution)


@query("t18_folded_units", ORACLES["t18_unit_state"])
def _t18_buckets(spark, sf):
    state = lambda rows: history.unit_state(rows, with_attempt=True)
    out = _in_batches(spark, "unit", unit_attempts(spark, sf), history.UNIT_KEYS, state, history.fold_units)
    return out.drop("frame_version_key", "window_key", "discovery_policy_version")


# ------------------------------------------------------------------ continuity as a stream
# Customers are scopes. Their first run scans the orders before 1996 (some have none: an empty run), three to a page, and was
# capped for every third scope. The second run scans all orders, for every fifth scope only the newest three with
# more behind them; some scopes have lost the orders at the watermark by then.

_SCANS = """WITH first AS (SELECT c_custkey AS scope, c_custkey % 3 = 0 AS more, count(o_orderkey) AS n, max(o_orderdate) AS top
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < timestamp '1996-01-01' GROUP BY ALL),
  run1 AS (SELECT *, NOT more AND n > 0 AS advanced FROM first),
  ranked AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderdate AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders),
  seen AS (SELECT r.*, CASE WHEN f.advanced THEN f.top END AS w FROM ranked r JOIN run1 f USING (scope)
    WHERE NOT (r.scope % 4 = 0 AND r.t = f.top AND f.top IS NOT NULL) AND (r.scope % 5 <> 0 OR r.pos <= 3)),
  crossing AS (SELECT scope, min(pos) FILTER (t < w) AS cross_pos FROM seen GROUP BY ALL),
  kept AS (SELECT scope, count(*) AS n, max(t) AS top, max(w) AS w FROM seen JOIN crossing USING (scope) WHERE cross_pos IS NULL OR pos < cross_pos GROUP BY ALL),
  lost AS (SELECT r.scope, count(*) AS n FROM ranked r JOIN run1 f ON f.scope = r.scope AND f.advanced AND r.t = f.top
    WHERE NOT EXISTS (SELECT 1 FROM seen s JOIN crossing c USING (scope) WHERE s.id = r.id AND (c.cross_pos IS NULL OR s.pos < c.cross_pos)) GROUP BY ALL),
  run2 AS (SELECT f.scope, CASE WHEN f.advanced THEN f.top END AS w, f.scope % 5 = 0 AS more, cross_pos IS NOT NULL AS crossed,
    coalesce(l.n, 0) AS lost, coalesce(k.n, 0) AS n, k.top FROM run1 f LEFT JOIN crossing c USING (scope) LEFT JOIN kept k USING (scope) LEFT JOIN lost l USING (scope)),
  named AS (SELECT *, CASE WHEN crossed AND lost = 0 THEN 'COMPLETE_TO_WATERMARK' WHEN NOT more AND crossed THEN 'POTENTIAL_GAP' WHEN NOT more THEN 'COMPLETE_TO_WATERMARK'
    WHEN w IS NULL THEN 'INITIAL_LOAD_CAPPED' ELSE 'CAPPED_BEFORE_WATERMARK' END AS status FROM run2)"""


@query(
    "x2_continuity_stream",
    f"""{_SCANS}
    SELECT scope, 1 AS run_number, CASE WHEN more THEN 'INITIAL_LOAD_CAPPED' ELSE 'COMPLETE_TO_WATERMARK' END AS continuity_status, 0 AS remaining_boundary_ids,
      n AS records_observed, NULL::TIMESTAMP AS committed_watermark_at, top AS candidate_watermark_at, advanced AS watermark_advanced,
      CASE WHEN advanced THEN top END AS next_watermark_at FROM run1
    UNION ALL SELECT scope, 2, status, lost, n, w, top, status = 'COMPLETE_TO_WATERMARK' AND top IS NOT NULL,
      CASE WHEN status = 'COMPLETE_TO_WATERMARK' AND top IS NOT NULL THEN top ELSE w END FROM named""",
)
def _x2_stream(spark, sf):
    """Two runs of every scope; some pages of the second one are there before the first is complete."""
    tables = continuity.continuity_tables(spark, scratch(spark, "continuity"), f"q{uuid.uuid4().hex}", "bigint", BUCKETS)
    arrived = scratch(spark, "scans")
    pages = scan_pages(spark, sf)
    early = (F.col("run_number") == 1) & (~F.col("is_last") | (F.col("scope") % 2 == 0)) | (F.col("run_number") == 2) & ~F.col("is_last")
    for name, part in (("early", early), ("late", ~early)):
        pages.filter(part).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{arrived}/{name}")
        continuity.run_scans(tables, f"{arrived}/*", f"{tables.root}-state", "bigint")
    return tables.live("continuity").drop("watermark_reached")


def scan_pages(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("scope"))
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("scope"), F.col("o_orderkey").cast("string").alias("source_comment_id"), F.col("o_orderdate").alias("published_at"), "o_orderkey"
    )
    old = F.col("published_at") < ntz("1996-01-01 00:00:00")
    tops = orders.filter(old).groupBy("scope").agg(F.max("published_at").alias("_top"))
    newest = Window.partitionBy("scope").orderBy(F.col("published_at").desc(), "o_orderkey")
    second = orders.withColumn("_pos", F.row_number().over(newest)).join(tops, "scope", "left")
    second = second.filter((F.col("scope") % 5 != 0) | (F.col("_pos") <= 3)).filter(~((F.col("scope") % 4 == 0) & F.coalesce(F.col("published_at") == F.col("_top"), F.lit(False))))
    pages = []
    for run, rows, more in ((1, orders.filter(old), F.col("scope") % 3 == 0), (2, second, F.col("scope") % 5 == 0)):
        place = F.row_number().over(newest) - 1
        item = F.struct("source_comment_id", "published_at")
        cut = rows.withColumn("place", place).groupBy("scope", F.floor(F.col("place") / 3).alias("page_number")).agg(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))).alias("items"))
        cut = customers.join(cut, "scope", "left").withColumn("page_number", F.coalesce("page_number", F.lit(0)))
        last = F.max("page_number").over(Window.partitionBy("scope")) == F.col("page_number")
        items = F.coalesce(F.transform("items", lambda i: i["item"]), F.array().cast("array<struct<source_comment_id: string, published_at: timestamp_ntz>>"))
        pages.append(cut.select("scope", F.lit(run).cast("bigint").alias("run_number"), "page_number", last.alias("is_last"), F.when(last, more).alias("more_pages"), items.alias("items")))
    return pages[0].unionByName(pages[1])


# ------------------------------------------------------------------ replay of stored pages
# Every page asks for a document and its ghost and returns the document. Even documents are known: their duration and language are
# frozen, every fourth one's snapshot is stored. Links of documents and ghosts to one event.


@query(
    "s7_replay_chain",
    f"""SELECT 'snapshot' AS table_name, CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'stored' ELSE 'new' END AS detail FROM videos
    UNION ALL SELECT 'video', CAST(doc_id AS VARCHAR), {_line("epoch_us(published_at)", "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE (n_chars % 99) * 60 + 5 END",
      "CASE WHEN doc_id % 2 = 0 THEN 'xx' WHEN doc_id % 6 = 3 THEN lower(lang) ELSE 'UNKNOWN' END")} FROM videos
    UNION ALL SELECT 'resolution', CAST(doc_id AS VARCHAR), 'RESOLVED|-|0' FROM videos
    UNION ALL SELECT 'resolution', 'ghost' || doc_id, 'UNAVAILABLE|NOT_RETURNED|0' FROM videos WHERE doc_id % 11 <> 0
    UNION ALL SELECT 'link', CAST(doc_id AS VARCHAR), 'ELIGIBLE|-' FROM videos
    UNION ALL SELECT 'link', 'ghost' || doc_id, CASE WHEN doc_id % 11 <> 0 THEN 'INELIGIBLE|VIDEO_UNAVAILABLE' ELSE 'ELIGIBLE|-' END FROM videos""",
    "videos",
)
def _s7_chain(spark, sf):
    """All stored pages, replayed twice."""
    buckets = buckets_for(2 * table(spark, sf, "documents").count())  # a document and its ghost
    tables = replay.video_tables(spark, scratch(spark, "replay"), f"q{uuid.uuid4().hex}", buckets)
    raw = written_once(video_pages(spark, sf))
    number = F.col("source_id").cast("bigint")
    items = landing.video_items(raw)
    with tables.batch(0) as batch:
        stored = landing.new_snapshots(items.limit(0), items.filter(number % 4 == 0))
        batch.append("snapshot", stored.withColumn("title", F.lit("stored")))
        known = items.filter(number % 2 == 0).select("source_id", F.lit(None).cast("timestamp_ntz").alias("published_at"), F.lit(1).cast("bigint").alias("duration_seconds"))
        known = known.withColumns({"is_short": F.lit(True), "short_classification_rule_version": F.lit("v1"), "primary_language_code": F.lit("xx")})
        batch.load("video", known)
        ids = F.explode(F.array("source_id", F.concat(F.lit("ghost"), "source_id"))).alias("source_id")
        none = F.lit(None).cast("string")
        batch.load("link", items.select(ids).select("source_id", F.lit("EV1").alias("event_version_key"), F.lit("ELIGIBLE").alias("inclusion_status"), none.alias("primary_exclusion_reason")))
    for number in (1, 2):
        replay.replay_videos(tables, raw, number)
    missing = lambda c: F.coalesce(c, F.lit("-"))
    details = {
        "snapshot": F.when(F.col("title") == "stored", F.lit("stored")).otherwise(F.lit("new")),
        "video": F.concat_ws("|", F.unix_micros(F.col("published_at").cast("timestamp")).cast("string"), F.col("duration_seconds").cast("string"), "primary_language_code"),
        "resolution": F.concat_ws("|", "resolution_status", missing("last_error_code"), F.col("retry_count").cast("string")),
        "link": F.concat_ws("|", "inclusion_status", missing("primary_exclusion_reason")),
    }
    out = None
    for name, detail in details.items():
        rows = tables.live(name).select(F.lit(name).alias("table_name"), "source_id", detail.alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def written_once(pages):
    """Landed pages as they lie in storage, so no replay makes them anew."""
    path = scratch(pages.sparkSession, "pages")
    pages.write.parquet(path)
    return pages.sparkSession.read.schema(pages.schema).parquet(path)
