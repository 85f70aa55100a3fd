"""What the operators of this folder share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import shared_dir

#: Rows in each Arrow batch that a task hands back.
OUT_ROWS = 4096


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, as ``--py-files`` would; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="ship-")
    if os.path.isdir(f"{top}/eventlens"):  # not when it runs from an archive that was shipped before
        sc.addPyFile(shutil.make_archive(f"{folder}/eventlens", "zip", top, "eventlens"))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the cluster's shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage of a wide frame: write it once as Parquet in the shared folder and read it.

    Readers get column pruning, and every reader sees the same rows, also after executors are lost.
    """
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, **named: str) -> list:
    """The given columns under own names: ``columns_of(df, id="doc_id")``; a missing column is an error."""
    return [df[f"`{column}`"].alias(alias) for alias, column in named.items()]


def whole_row(df: DataFrame):
    """All columns as one struct, so that no name of theirs can clash with an operator's."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def batches_of(rows: Iterable[tuple], schema: pa.Schema, rows_each: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows_each`` of the given tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= rows_each:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_held: dict[str, Callable[[], None]] = {}


def make_room(name: str, release: Callable[[], None] | None = None) -> None:
    """Where a task begins: what other operators have kept in this Python worker is released, as Spark uses workers again.

    ``release`` forgets what the operator ``name`` keeps from task to task.
    """
    for other in [n for n in _held if n != name]:
        _held.pop(other)()
    if release is not None:
        _held[name] = release


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
