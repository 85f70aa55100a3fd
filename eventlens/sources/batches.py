"""Tables that change together, one batch at a time.

Every table is a Parquet table of Spark's catalog, in shared storage. What a batch writes lies under its
`batch_id`; a marker that is written last makes the batch count, for all tables at once. Readers see the rows of
marked batches only. A batch that failed half-way is run again under its id: what it left is removed first, so
each row is there once, however often that happens.

An append table keeps the rows of every batch. A keyed table is bucketed on its natural key, and its partition
`bucket` is Spark's own bucket number: a bucket's live rows are those of the last marked batch that
wrote it. A merge reads the live files of just those buckets that incoming keys fall into, joins them where they
lie (the incoming side alone is shuffled), and writes these buckets anew; all others stay untouched.

A working table holds rows of one batch while it lasts: they are laid out and read as those of a keyed table, and
removed when the batch ends. Files are compressed with Zstandard: keys and digests are hexadecimal texts, which it halves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.errors import GateError
from eventlens.session import durable

MARKER = "batch_id bigint, table_name string, buckets array<int>"


@dataclass(frozen=True)
class Layout:
    """Columns as DDL; the columns that a keyed table is laid out on, into how many buckets; if it is a working table."""

    columns: str
    keys: tuple[str, ...] = ()
    buckets: int = 64
    working: bool = False

    @property
    def names(self) -> list[str]:
        return [field.split()[0] for field in re.split(r",\s*(?![^<(]*[>)])", self.columns)]

    def bucket(self) -> Column:
        """The number that Spark gives to the bucket of a row."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Fixed:
    """Rows made of written ones by a rule that always gives the same, and the buckets that their keys fall into."""

    rows: DataFrame
    buckets: list[int]


class BatchTables:
    """The tables under `root`, registered in the catalog as `<prefix>_<name>`."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout], prefix: str) -> None:
        self.spark, self.root, self.layouts, self.prefix = spark, root.rstrip("/"), layouts, prefix
        for name, layout in layouts.items():
            there = self._exists(f"{self.root}/{name}")
            laid = "PARTITIONED BY (batch_id)"
            extra = "batch_id bigint"
            if layout.keys:
                key = ", ".join(layout.keys)
                extra += ", bucket int"
                laid = f"PARTITIONED BY (batch_id, bucket) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {layout.buckets} BUCKETS"
            known = spark.catalog.tableExists(self._table(name))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({layout.columns}, {extra}) USING parquet OPTIONS (compression 'zstd') {laid} LOCATION '{self.root}/{name}'")
            if there and not known:  # written by an earlier application
                spark.catalog.recoverPartitions(self._table(name))

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _path(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._path(path)
        return fs.exists(hadoop)

    def markers(self) -> DataFrame:
        """(batch_id, table_name, buckets): what each marked batch wrote; buckets are empty for append tables."""
        path = f"{self.root}/markers"
        if not self._exists(path):
            return self.spark.createDataFrame([], MARKER)
        return self.spark.read.schema(MARKER).option("recursiveFileLookup", "true").json(path)

    def is_marked(self, batch_id: int) -> bool:
        return not self.markers().filter(F.col("batch_id") == batch_id).isEmpty()

    def live(self, name: str, buckets: Iterable[int] | None = None, since: int = 0) -> DataFrame:
        """Rows of marked batches, of some buckets of a keyed table or of all; other files aren't read.

        Of an append table the batches from `since` on.

        The batch of each bucket is one number for a bucket, so the filter is as small as the layout.
        """
        layout, rows = self.layouts[name], self.spark.table(self._table(name))
        mine = self.markers().filter(F.col("table_name") == name)
        if not layout.keys:
            batches = [r[0] for r in mine.select("batch_id").distinct().collect()]
            return rows.filter(F.col("batch_id").isin([b for b in batches if b >= since])).select(*layout.names)
        last = mine.select("batch_id", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("batch_id").alias("last"))
        wanted = None if buckets is None else set(buckets)
        pairs = [(r["bucket"], r["last"]) for r in last.collect() if wanted is None or r["bucket"] in wanted]
        alive = F.col("batch_id").isNull()  # of no partition; a constant would lose the layout that a join relies on
        for batch in sorted({b for _, b in pairs}):
            alive = alive | ((F.col("batch_id") == batch) & F.col("bucket").isin([k for k, b in pairs if b == batch]))
        return rows.filter(alive).select(*layout.names)

    def buckets_of(self, name: str, keyed: DataFrame) -> list[int]:
        """Buckets that the keys of some rows fall into: numbers, no more than the layout has."""
        bucket = self.layouts[name].bucket().alias("bucket")
        return sorted(r[0] for r in keyed.select(bucket).distinct().collect())

    def batch(self, batch_id: int) -> Batch:
        return Batch(self, batch_id)

    def drop_superseded(self, name: str) -> list[int]:
        """Forget batches of which no bucket is live any more, and give their ids; their files are removed."""
        layout = self.layouts[name]
        mine = self.markers().filter(F.col("table_name") == name)
        last = mine.select("batch_id", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
        dead = mine.select("batch_id").distinct().join(last.select("batch_id").distinct(), "batch_id", "left_anti")
        gone = sorted(r[0] for r in dead.collect()) if layout.keys else []
        for batch_id in gone:
            self._remove(name, batch_id)
        return gone

    def _remove(self, name: str, batch_id: int) -> None:
        fs, hadoop = self._path(f"{self.root}/{name}/batch_id={batch_id}")
        if fs.exists(hadoop):
            fs.delete(hadoop, True)
            self.spark.sql(f"ALTER TABLE {self._table(name)} DROP IF EXISTS PARTITION (batch_id = {batch_id})")
            self.spark.catalog.refreshTable(self._table(name))


class Batch:
    """Writes of one batch. They count from `mark()` on; leaving the block without an error marks the batch."""

    def __init__(self, tables: BatchTables, batch_id: int) -> None:
        if tables.is_marked(batch_id):
            raise GateError(f"batch {batch_id} is already marked")
        self.tables, self.batch_id, self._wrote = tables, batch_id, {}
        for name in tables.layouts:
            tables._remove(name, batch_id)

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.mark()
        for name, layout in self.tables.layouts.items():
            if layout.working:
                self.tables._remove(name, self.batch_id)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows of an append table, and give them as they were written."""
        self._write(name, rows, [])
        return self._written(name)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a working table, and as they were written: they lie in its buckets until the batch ends.

        Rows that are dealt on the table's keys already, into as many parts, aren't shuffled again.
        """
        self._write(name, rows, [], marked=False)
        return self._written(name)

    def _written(self, name: str) -> DataFrame:
        written = self.tables.spark.table(self.tables._table(name))
        return written.filter(F.col("batch_id") == self.batch_id).select(*self.tables.layouts[name].names)

    def merge(self, name: str, incoming: DataFrame | Fixed, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`rule(stored, incoming)` gives the new rows of the buckets that hold the keys of `incoming`.

        The rule joins on all key columns, so the stored side stays where it is. Incoming rows are fixed first, as
        the rule and the choice of buckets have to see the same, unless the caller gives them as `Fixed`.
        """
        if not isinstance(incoming, Fixed):
            incoming = durable(incoming)
            incoming = Fixed(incoming, self.tables.buckets_of(name, incoming))
        if incoming.buckets:
            self._write(name, rule(self.tables.live(name, incoming.buckets), incoming.rows), incoming.buckets)

    def load(self, name: str, rows: DataFrame) -> None:
        """Fill a keyed table anew: one shuffle into its buckets, all of which belong to this batch from now on."""
        layout = self.tables.layouts[name]
        self._write(name, rows.repartition(layout.buckets, *layout.keys), list(range(layout.buckets)))

    def _write(self, name: str, rows: DataFrame, buckets: list[int], marked: bool = True) -> None:
        if name in self._wrote:
            raise GateError(f"{name} is written once in a batch")
        layout = self.tables.layouts[name]
        rows = rows.select(*layout.names).withColumn("batch_id", F.lit(self.batch_id).cast("bigint"))
        if layout.keys:
            rows = rows.withColumn("bucket", layout.bucket())
        rows.write.insertInto(self.tables._table(name))
        if marked:
            self._wrote[name] = buckets

    def mark(self) -> None:
        """One small file, written as a whole or not at all."""
        rows = [(self.batch_id, name, buckets) for name, buckets in self._wrote.items()] or [(self.batch_id, "", [])]
        marker = self.tables.spark.createDataFrame(rows, MARKER).coalesce(1)
        marker.write.mode("overwrite").json(f"{self.tables.root}/markers/batch={self.batch_id}")
