"""Sharding by sampled splitters, with DataFrame functions only.

Rows get a key, a hash of the text and the id, so equal texts lie side by side and no two rows tie
on it in practice. A size-weighted sample of the keys gives quantile boundaries of far more
ranges than shards, each of about the same number of bytes. Records are dealt out to these ranges,
each cut into cells of bounded rows; exact running sums over cells, and over the rows within
each cell, place every row in the order of bytes. Shards are equal stretches of that
order, so a range that would overfill a shard is subdivided at the exact row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import columns_of
from eventlens.session import durable

OVERHEAD = 8
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 16
CELL_ROWS = 250_000


def shard_by_bytes(
    df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = RANGES_PER_SHARD, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to shards - 1), slot (from 0 in each shard, without gaps).

    Size: the text's UTF-8 bytes plus 8; a null text has none and its checksum is that of an empty one.
    The bytes of any two shards differ by less than two of the largest rows. Null ids and repeated rows are
    rows like any others; other columns are ignored; an empty table gives no rows.
    """
    packed = df.select(*columns_of(df, id=id_col, text=text_col))
    body = F.coalesce("text", F.lit(""))
    rows = packed.select(
        "id",
        (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.struct(F.xxhash64(body).alias("t"), F.xxhash64(F.col("id").cast("string")).alias("i")).alias("key"),
    )
    rows = durable(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranged = rows.withColumn("range", _range_of(F.col("key"), _boundaries(rows, total, shards * ranges_per_shard)))

    # cells, so that no window holds more than about cell_rows rows, however many a range has
    largest = ranged.groupBy("range").count().agg(F.max("count")).first()[0] or 0
    cell = F.pmod(F.xxhash64("key", F.lit(shards)), F.lit(max(1, -(-largest // cell_rows))))
    celled = durable(ranged.withColumn("cell", cell))
    window = Window.partitionBy("range", "cell").orderBy("key", "id", "size", "text_crc32")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    local = celled.withColumns({"bytes_in": F.coalesce(F.sum("size").over(before), F.lit(0)), "row_in": F.row_number().over(window) - 1})

    # one row per cell
    totals = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("range", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range",
        "cell",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    placed = local.join(offsets, ["range", "cell"])
    middle = F.col("bytes_before") + F.col("bytes_in") + F.expr("size div 2")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    numbered = durable(placed.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("row_in")).alias("number")))
    # at most one row per shard
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("number").alias("first")))
    return numbered.join(first, "shard").select("id", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"))


def _boundaries(rows: DataFrame, total: int, ranges: int) -> list:
    """Keys that cut the bytes into about equal ranges: quantiles of a size-weighted sample.

    Each row draws an exponential waiting time at the rate of its size; the shortest are a sample
    without replacement weighted by size. The draw is a hash, so a task that runs again repeats it.
    The sample, a few thousand keys whatever the input, is all that reaches the driver.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    uniform = (F.pmod(F.xxhash64("key", "size", F.lit("draw")), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = rows.select("key", (-F.log(uniform) / F.col("size")).alias("wait"))
    # about 1.5 times as many as wanted wait no longer than this, so partitions hand on few of their rows
    soon = drawn.where(F.col("wait") <= 1.5 * (wanted + 20) / max(total, 1)).orderBy("wait", "key").limit(wanted)
    keys = sorted((r["key"]["t"], r["key"]["i"]) for r in soon.collect())
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    return sorted(set(cuts))


def _range_of(key: Column, cuts: list) -> Column:
    """The number of boundaries at or below the key: first among every w-th of them, then among the w that follow."""
    if not cuts:
        return F.lit(0)
    w = max(1, round(len(cuts) ** 0.5))
    every = [F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in cuts]

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda cut: cut <= key))

    coarse = passed(F.array(*every[w - 1 :: w])) * w
    return coarse + passed(F.slice(F.array(*every), coarse + 1, w - 1)) if w > 1 else coarse
