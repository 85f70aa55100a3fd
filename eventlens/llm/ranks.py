"""Places of rows within their group, for groups of any size.

Rows are range-partitioned on group *and* order, so a group with a third of all rows covers many
slices; a row's place is its number in the slice plus what the earlier slices hold of its group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import written


def numbered(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): the rows with ``slice`` and ``at`` (their number in the slice), sorted by group and order, nulls first.

    runs, one row for each group in each slice: the group, ``slice``, ``first`` (its smallest ``at``), ``before``
    (rows of the group in earlier slices) and ``total`` (rows of the group). ``placed`` brings the two together.
    Rows that are equal in group and order come in any order, the same for every reader.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    number = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    rows = sliced.withColumn("at", number).withColumn("slice", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    rows = written(rows, "ranked")
    runs = rows.groupBy(*group, "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "slice", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    return rows, runs


def placed(rows: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """The rows with ``pos`` (from 0 in the group) and what else ``runs`` has; runs are few rows for each slice."""
    other = runs.select(*[F.col(c).alias(f"run_{c}") for c in runs.columns])
    on = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in (*group, "slice")])
    more = [F.col(f"run_{c}").alias(c) for c in runs.columns if c not in (*group, "slice", "first", "before")]
    kept = [F.col(c) for c in rows.columns if c not in ("slice", "at")]
    return rows.join(other, on).select(*kept, (F.col("at") - F.col("run_first") + F.col("run_before")).alias("pos"), *more)
