"""Continuity of scans as a stream: watermarks and boundary ids are state that each complete run moves on.

Pages of scans arrive in any micro-batch. A run counts once all its pages are there, up to the one that says it was
the last; its scope's watermark and the ids at it are then compared with what the run saw, and moved if it
was complete. Runs of one scope are taken in the order of their numbers, all scopes at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlens.operators import completeness
from eventlens.operators.joins import upsert
from eventlens.session import durable
from eventlens.sources.batches import BatchTables, Layout

_RUN = ["scope", "run_number"]
_STATE = (
    "continuity_status string, watermark_reached boolean, remaining_boundary_ids bigint, records_observed bigint, "
    "committed_watermark_at timestamp_ntz, candidate_watermark_at timestamp_ntz, watermark_advanced boolean, next_watermark_at timestamp_ntz"
)


def page_schema(scope: str = "string") -> str:
    """A page of a scan: the last one says whether the source had more."""
    item = "struct<source_comment_id: string, published_at: timestamp_ntz>"
    return f"scope {scope}, run_number bigint, page_number bigint, is_last boolean, more_pages boolean, items array<{item}>"


def continuity_tables(spark: SparkSession, root: str, prefix: str, scope: str = "string", buckets: int = 64) -> BatchTables:
    run = f"scope {scope}, run_number bigint"
    return BatchTables(
        spark,
        root,
        {
            "scan_item": Layout(f"{run}, page_number bigint, item_position bigint, source_comment_id string, published_at timestamp_ntz"),
            "scan": Layout(f"{run}, pages bigint, expected bigint, more_pages boolean, first_batch bigint", tuple(_RUN), buckets),
            "checkpoint": Layout(f"scope {scope}, committed_watermark_at timestamp_ntz, committed_run bigint, last_run bigint", ("scope",), buckets),
            "boundary": Layout(f"{run}, source_comment_id string, watermark_at timestamp_ntz"),
            "continuity": Layout(f"{run}, {_STATE}"),
        },
        prefix,
    )


def _progress(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of a run that have arrived, over all batches."""
    seen = new.select(*_RUN, F.struct("pages", "expected", "more_pages", "first_batch").alias("_n"))
    return stored.join(seen, _RUN, "full_outer").select(
        *_RUN,
        (F.coalesce("pages", F.lit(0)) + F.coalesce("_n.pages", F.lit(0))).alias("pages"),
        F.coalesce("expected", "_n.expected").alias("expected"),
        F.coalesce("more_pages", "_n.more_pages").alias("more_pages"),
        F.least("first_batch", "_n.first_batch").alias("first_batch"),
    )


def fold(tables: BatchTables, pages: DataFrame, batch_id: int) -> None:
    """One micro-batch: keep its pages, and take every run that is complete now.

    A run whose number isn't above the last one taken for its scope is logged as SUPERSEDED and moves nothing. Each page
    arrives once, as a file source gives it.
    """
    if tables.is_marked(batch_id):
        return
    with tables.batch(batch_id) as batch:
        item = F.posexplode("items").alias("item_position", "item")
        exploded = pages.select(*_RUN, "page_number", item).select(*_RUN, "page_number", F.col("item_position").cast("bigint").alias("item_position"), "item.*")
        arrived = batch.append("scan_item", exploded)
        ended = F.col("is_last")
        new = durable(
            pages.groupBy(*_RUN).agg(
                F.count(F.lit(1)).alias("pages"),
                F.max(F.when(ended, F.col("page_number") + 1)).alias("expected"),
                F.max(F.when(ended, F.col("more_pages"))).alias("more_pages"),
                F.lit(batch_id).cast("bigint").alias("first_batch"),
            )
        )
        so_far = _progress(tables.live("scan", tables.buckets_of("scan", new)).join(new, _RUN, "left_semi"), new)
        checkpoints = tables.live("checkpoint", tables.buckets_of("checkpoint", new)).join(new.select("scope").distinct(), "scope", "left_semi")
        taken = checkpoints.select("scope", F.col("last_run").alias("_last"))
        order = F.row_number().over(Window.partitionBy("scope", "_late").orderBy("run_number"))
        late = F.coalesce(F.col("run_number") <= F.col("_last"), F.lit(False))
        complete = so_far.filter("pages = expected").join(taken, "scope", "left").withColumn("_late", late)
        ready = durable(complete.withColumn("round", F.when(~F.col("_late"), order)).drop("_last", "_late"))
        rounds, since = ready.agg(F.max("round"), F.min("first_batch")).first()
        items = tables.live("scan_item", since=since or 0).unionByName(arrived).join(ready.select(*_RUN), _RUN, "left_semi")
        marks = durable(checkpoints)
        boundary = tables.live("boundary").join(marks.select("scope", F.col("committed_run").alias("run_number")), _RUN, "left_semi")
        log = [ready.filter("round IS NULL").select(*_RUN, F.lit("SUPERSEDED").alias("continuity_status"))]
        for number in range(1, (rounds or 0) + 1):
            now = ready.filter(F.col("round") == number)
            marks, boundary, states = _round(now, items, marks, boundary)
            log.append(states)
        everything = log[0]
        for part in log[1:]:
            everything = everything.unionByName(part, allowMissingColumns=True)
        batch.append("continuity", everything.select(*[F.col(c) if c in everything.columns else F.lit(None).alias(c) for c in tables.layouts["continuity"].names]))
        fresh = boundary.join(ready.select(*_RUN), _RUN, "left_semi")
        batch.append("boundary", fresh)
        moved = marks.join(ready.filter("round IS NOT NULL").select("scope").distinct(), "scope", "left_semi")
        batch.merge("checkpoint", moved, lambda old, rows: upsert(old, rows, ["scope"], ["committed_watermark_at", "committed_run", "last_run"]))
        batch.merge("scan", new, _progress)


def _round(now: DataFrame, items: DataFrame, marks: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of each scope: the checkpoints and boundary ids after it, and its state."""
    mine = items.join(now.select(*_RUN), _RUN, "left_semi")
    committed = marks.filter("committed_watermark_at IS NOT NULL").select("scope", "committed_watermark_at")
    states = completeness.continuity(mine, now.select("scope", "more_pages"), committed.join(now, "scope", "left_semi"), boundary.join(now.select("scope"), "scope", "left_semi"))
    states = durable(completeness.advance_watermark(states).join(now.select(*_RUN), "scope"))
    advanced = states.filter("watermark_advanced")
    ids = completeness.boundary_ids(mine, advanced).join(advanced.select(*_RUN), "scope").select(*_RUN, "source_comment_id", "watermark_at")
    kept = boundary.join(advanced.select("scope"), "scope", "left_anti").select(*_RUN, "source_comment_id", "watermark_at")
    moves = states.select("scope", F.struct("watermark_advanced", "next_watermark_at", "run_number").alias("_n"))
    step = F.coalesce(F.col("_n.watermark_advanced"), F.lit(False))
    after = marks.join(moves, "scope", "full_outer").select(
        "scope",
        F.when(step, F.col("_n.next_watermark_at")).otherwise(F.col("committed_watermark_at")).alias("committed_watermark_at"),
        F.when(step, F.col("_n.run_number")).otherwise(F.col("committed_run")).alias("committed_run"),
        F.greatest("last_run", "_n.run_number").alias("last_run"),
    )
    return durable(after), durable(kept.unionByName(ids)), states


def run_scans(tables: BatchTables, path: str, checkpoint: str, scope: str = "string", max_files: int = 1000) -> StreamingQuery:
    """Take the page files that have arrived since the checkpoint, and stop."""
    stream = tables.spark.readStream.schema(page_schema(scope)).option("maxFilesPerTrigger", max_files).json(path)
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: fold(tables, batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def current_boundary(tables: BatchTables) -> DataFrame:
    """Ids at the committed watermark of each scope."""
    committed = tables.live("checkpoint").select("scope", F.col("committed_run").alias("run_number"))
    return tables.live("boundary").join(committed, _RUN, "left_semi").select("scope", "source_comment_id", "watermark_at")
