"""Row numbers and neighbours inside groups of any size.

A plain window brings a whole group into one task. That is fine while groups are small;
a single hot group (one viral video, one huge stratum) would make that task the job.
Beyond `HOT_GROUP_ROWS` the rows are range-partitioned on (group, order), so a hot group
spreads over many slices, fixed once in reliable storage, numbered inside each slice, and
joined with the few per-slice boundary rows. Both ways give the same rows.

`order` must end in a unique column, so the order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import durable

HOT_GROUP_ROWS = 5_000_000
MAX_BROADCAST_ROWS = 200_000
#: Rows that one task takes at once of rows dealt by key.
ROWS_PER_TASK = 1_000_000


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """TRUE when `df` has at most `max_rows` rows; reads no more than that plus one."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a checked size; beyond it the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if fits(df, max_rows) else df


def has_hot_group(df: DataFrame, group: Sequence[str], limit: int | None = None) -> bool:
    """One map-side combined count over the group columns only."""
    limit = HOT_GROUP_ROWS if limit is None else limit
    biggest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    return (biggest or 0) > limit


def even_parts(df: DataFrame, keys: Sequence[str], rows: int, limit: int) -> int | None:
    """Partitions of at most `limit` rows or so for `rows` rows dealt on their keys; None if a hot key makes one much larger."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // limit))
    place = F.pmod(F.hash(*keys), F.lit(parts)).alias("_place")
    biggest = df.groupBy(place).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return parts if (biggest or 0) <= 4 * limit else None


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt on their keys into as many partitions as they need, so that tasks don't grow with the table.

    Adaptive execution merges partitions by their compressed bytes, and narrow rows compress to little. It keeps what few
    rows need, and the rows of a hot key, which it splits in joins.
    """
    rows = df.count()
    parts = even_parts(df, keys, rows, ROWS_PER_TASK) if rows > ROWS_PER_TASK else None
    return df if parts is None else df.repartition(parts, *keys)


def _slices(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
    return durable(ranged.withColumn("_slice", F.spark_partition_id()))


def _attach(rows: DataFrame, small: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the per-(group, slice) rows back; their key columns are renamed, so nothing is ambiguous."""
    keys = {g: f"_g{i}" for i, g in enumerate(group)} | {"_slice": "_s"}
    side = bounded(small.withColumnsRenamed(keys))
    cond = F.lit(True)
    for g, renamed in keys.items():
        cond = cond & F.col(g).eqNullSafe(F.col(renamed))
    return rows.join(side, cond).drop(*keys.values())


def ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", hot: int | None = None
) -> DataFrame:
    """Dense position 1..n of every row in its group."""
    if not has_hot_group(df, group, hot):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    rows = _slices(df, group, order)
    sizes = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)))
    return _attach(local, offsets, group).select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name)
    )


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    hot: int | None = None,
    is_hot: bool | None = None,
) -> DataFrame:
    """Values of the previous / next row of the group.

    `before` and `after` map new column names to existing ones. A row without such a
    neighbour gets NULL. Groups are counted unless the caller knows if one `is_hot`.
    """
    before, after = before or {}, after or {}
    if not (has_hot_group(df, group, hot) if is_hot is None else is_hot):
        w = Window.partitionBy(*group).orderBy(*order)
        out = df
        for name, source in before.items():
            out = out.withColumn(name, F.lag(source).over(w))
        for name, source in after.items():
            out = out.withColumn(name, F.lead(source).over(w))
        return out

    rows = _slices(df, group, order)
    w = Window.partitionBy(*group, "_slice").orderBy(*order)
    local = rows.withColumn("_first", F.lag(F.lit(True)).over(w).isNull()).withColumn(
        "_last", F.lead(F.lit(True)).over(w).isNull()
    )
    for name, source in before.items():
        local = local.withColumn(name, F.lag(source).over(w))
    for name, source in after.items():
        local = local.withColumn(name, F.lead(source).over(w))

    # one row per (group, slice): its edge values, handed to the neighbouring slices
    edge_values = [F.max(F.when(F.col("_last"), F.col(s))).alias(f"_l_{n}") for n, s in before.items()]
    edge_values += [F.max(F.when(F.col("_first"), F.col(s))).alias(f"_f_{n}") for n, s in after.items()]
    edges = local.filter("_first OR _last").groupBy(*group, "_slice").agg(*edge_values)
    over_slices = Window.partitionBy(*group).orderBy("_slice")
    carried = edges.select(
        *group,
        "_slice",
        *[F.lag(f"_l_{n}").over(over_slices).alias(f"_p_{n}") for n in before],
        *[F.lead(f"_f_{n}").over(over_slices).alias(f"_n_{n}") for n in after],
    )
    return _attach(local, carried, group).select(
        *df.columns,
        *[F.when(F.col("_first"), F.col(f"_p_{n}")).otherwise(F.col(n)).alias(n) for n in before],
        *[F.when(F.col("_last"), F.col(f"_n_{n}")).otherwise(F.col(n)).alias(n) for n in after],
    )


def time_slice(at: Column, days: int) -> Column:
    """Number of the span of `days` that an instant falls into; a hot key is cut along these."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(days * 86_400_000_000)).cast("bigint")


def sliced_neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    slice_: Column,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """`neighbours` without a look at the data: groups are cut into slices that are a function of the order.

    `slice_` never falls along `order`. Rows move once, to their group and slice; a group's slices hand
    their edge rows on, one row for each slice. Nothing runs while the query is built.
    """
    before, after = before or {}, after or {}
    rows = df.withColumn("_slice", slice_)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    local = rows.withColumns(
        {
            "_first": F.lag(F.lit(True)).over(inside).isNull(),
            "_last": F.lead(F.lit(True)).over(inside).isNull(),
            **{name: F.lag(source).over(inside) for name, source in before.items()},
            **{name: F.lead(source).over(inside) for name, source in after.items()},
        }
    )
    # structs, so that a NULL at the edge is told from no edge
    last = F.max(F.when(F.col("_last"), F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(before.values())]))) if before else F.lit(None)
    first = F.max(F.when(F.col("_first"), F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(after.values())]))) if after else F.lit(None)
    edges = local.groupBy(*group, "_slice").agg(last.alias("_l"), first.alias("_f"))
    across = Window.partitionBy(*group).orderBy("_slice")
    keys = {c: f"_k{i}" for i, c in enumerate([*group, "_slice"])}
    carried = edges.select(*[F.col(c).alias(k) for c, k in keys.items()], F.lag("_l").over(across).alias("_pl"), F.lead("_f").over(across).alias("_nf"))
    on = F.lit(True)
    for c, k in keys.items():
        on = on & F.col(c).eqNullSafe(F.col(k))
    out = local.join(carried, on)
    return out.select(
        *df.columns,
        *[F.when(F.col("_first"), F.col(f"_pl.b{i}")).otherwise(F.col(n)).alias(n) for i, n in enumerate(before)],
        *[F.when(F.col("_last"), F.col(f"_nf.a{i}")).otherwise(F.col(n)).alias(n) for i, n in enumerate(after)],
    )


_RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, tuple[str, str]],
    hot: int | None = None,
) -> DataFrame:
    """Running sum, min or max over the rows strictly before each row.

    `columns` maps a new name to (aggregate, source column); the first row gets NULL.
    """

    def over(window) -> dict[str, Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        return {n: _RUNNING[agg][0](source).over(frame) for n, (agg, source) in columns.items()}

    if not has_hot_group(df, group, hot):
        return df.withColumns(over(Window.partitionBy(*group).orderBy(*order)))
    rows = _slices(df, group, order)
    local = rows.withColumns(over(Window.partitionBy(*group, "_slice").orderBy(*order)))
    totals = rows.groupBy(*group, "_slice").agg(
        *[_RUNNING[agg][0](source).alias(f"_t_{n}") for n, (agg, source) in columns.items()]
    )
    frame = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, "_slice", *[_RUNNING[agg][0](f"_t_{n}").over(frame).alias(f"_c_{n}") for n, (agg, _) in columns.items()]
    )
    return _attach(local, carried, group).select(
        *df.columns,
        *[_RUNNING[agg][1](F.col(n), F.col(f"_c_{n}")).alias(n) for n, (agg, _) in columns.items()],
    )


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", hot: int | None = None
) -> DataFrame:
    """Equi-join ("inner" or "left") of facts with a few rows per key, safe when one key holds most facts.

    Keys with more than `HOT_GROUP_ROWS` facts are few by definition (rows / limit), so their
    facts stay where they are and meet the broadcast rows of just those keys; all other facts
    shuffle as usual. Without such keys it is the plain join.
    """
    limit = HOT_GROUP_ROWS if hot is None else hot
    heavy = left.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    if not heavy.limit(1).count():
        return left.join(right, list(keys), how)
    heavy = F.broadcast(heavy)
    marked = left.join(heavy.withColumn("_hot", F.lit(True)), list(keys), "left")
    side = bounded(right.join(heavy, list(keys), "left_semi"))
    in_place = marked.filter("_hot").drop("_hot").join(side, list(keys), how)
    shuffled = marked.filter("_hot IS NULL").drop("_hot").join(right, list(keys), how)
    return in_place.unionByName(shuffled)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in the other columns, in their order, however the rows are read."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*[c if c in keys else F.col(f"_least.{c}").alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in `order`; Spark limits every group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
