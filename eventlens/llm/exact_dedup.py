"""Exact deduplication by Grace hashing.

1. Every Arrow batch of the scan is reduced in place: an open-addressing table that compares
   complete normalised contents gives one representative (smallest id) for each distinct text of
   the batch. Copies leave as narrow member rows, so a text that a third of all rows share is
   shuffled once for each batch, not once for each row.
2. Representatives are shuffled by content hash. A task reads its partition into such a table;
   when the contents outgrow ``bucket_bytes``, all of it goes to 16 spill files by the next four
   bits of the hash, and each file is treated in the same way until it fits. If only the rows that
   stay are asked for, they travel with the contents and leave here.
3. Narrow member rows are joined to their class by the batch-local key, of which one has at most
   a batch of rows.

Spill files are private to a running task and removed when it ends; a lost executor only makes
Spark run the task again. Shared data lie in the cluster's folder.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of, utf8, whole_row, written

BUCKET_BYTES = 64 << 20
FANOUT_BITS = 4
HASH_BITS = 64


def normalised(text: bytes) -> bytes:
    r"""Each run of ``[\x20\x09-\x0D]`` as one space; ``bytes.split`` knows just these as white space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    if text[:1].isspace():
        out = b" " + out
    return out + b" " if text[-1:].isspace() else out


class OpenTable:
    """Open addressing with linear probing; equal means equal hash and equal complete content."""

    def __init__(self, bits: int = 8) -> None:
        self.mask = (1 << bits) - 1
        self.slots = array("q", [-1]) * (1 << bits)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def number(self, code: int, content: bytes) -> int:
        """The class number of a content, a new one if it isn't there yet."""
        at = self._slot(code, content)
        found = self.slots[at]
        if found >= 0:
            return found
        self.slots[at] = len(self.hashes)
        self.hashes.append(code)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.hashes) > self.mask:
            self._grow()
        return len(self.hashes) - 1

    def _slot(self, code: int, content: bytes) -> int:
        at = code & self.mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == code and self.contents[found] == content:
                break
            at = (at + 1) & self.mask
        return at

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for number, code in enumerate(self.hashes):
            at = code & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = number


def _order(doc_id):
    """Smallest id first, null last."""
    return (doc_id is None, doc_id if doc_id is not None else 0)


def _reduce_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (key, id, first, n, hash, row) of each batch; keys are unique over all tasks."""
    context = TaskContext.get()
    next_key = (context.partitionId() if context else 0) << 40
    for batch in batches:
        table, classes = OpenTable(12), []
        for text in utf8(batch.column("text")):
            content = normalised(text)
            classes.append(table.number(xxhash.xxh3_64_intdigest(content), content))
        ids = batch.column("id").to_pylist()
        best: dict[int, int] = {}
        sizes = [0] * len(table.hashes)
        for row, number in enumerate(classes):
            sizes[number] += 1
            if number not in best or _order(ids[row]) < _order(ids[best[number]]):
                best[number] = row
        first = [best[number] == row for row, number in enumerate(classes)]
        columns = {
            "key": pa.array([next_key + number for number in classes], pa.int64()),
            "id": batch.column("id"),
            "first": pa.array(first, pa.bool_()),
            "n": pa.array([sizes[number] for number in classes], pa.int64()),
            "hash": pa.array([table.hashes[n] - (1 << 63) if f else None for f, n in zip(first, classes)], pa.int64()),
            "row": batch.column("row").take(pa.array([row if f else None for row, f in enumerate(first)], pa.int64())),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        next_key += len(sizes)


class _Members:
    """What is known of one class: the keys of its representatives, the best (id, key, row) and their sum.

    The row is that of the best one if rows are carried, else None.
    """

    __slots__ = ("keys", "best", "size")

    def __init__(self) -> None:
        self.keys, self.best, self.size = array("q"), None, 0

    def add(self, key: int, doc_id, size: int, row=None) -> None:
        self.keys.append(key)
        self.size += size
        if self.best is None or (_order(doc_id), key) < (_order(self.best[0]), self.best[1]):
            self.best = (doc_id, key, row)

    def merge(self, other: _Members) -> None:
        self.keys.extend(other.keys)
        self.size += other.size
        if self.best is None or (_order(other.best[0]), other.best[1]) < (_order(self.best[0]), self.best[1]):
            self.best = other.best


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, _Members]]:
    for batch in batches:
        carried = "row" in batch.schema.names
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [part.column(c).to_pylist() for c in ("key", "id", "n", "hash")]
            rows = part.column("row").to_pylist() if carried else [None] * part.num_rows
            for key, doc_id, size, code, text, row in zip(*columns, utf8(part.column("text")), rows):
                one = _Members()
                one.add(key, doc_id, size, row)
                yield code + (1 << 63), normalised(text), one


def grace_classes(records: Iterable[tuple[int, bytes, _Members]], bucket_bytes: int, level: int = 0) -> Iterator[tuple[bytes, _Members]]:
    """(content, members) of every distinct content, holding about ``bucket_bytes`` of contents at once."""
    table, members = OpenTable(), []
    records = iter(records)
    for code, content, more in records:
        number = table.number(code, content)
        if number == len(members):
            members.append(more)
        else:
            members[number].merge(more)
        if table.bytes > bucket_bytes and len(members) > 1 and (level + 1) * FANOUT_BITS <= HASH_BITS:
            break
    else:
        yield from zip(table.contents, members)
        return
    shift = HASH_BITS - (level + 1) * FANOUT_BITS
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(f"{folder}/{bucket}", "w+b") for bucket in range(1 << FANOUT_BITS)]  # noqa: SIM115
        try:
            for code, content, more in zip(table.hashes, table.contents, members):
                pickle.dump((code, content, more.keys, more.best, more.size), files[code >> shift & 15])
            del table, members
            for code, content, more in records:
                pickle.dump((code, content, more.keys, more.best, more.size), files[code >> shift & 15])
            for file in files:
                file.seek(0)
                yield from grace_classes(_spilled(file), bucket_bytes, level + 1)
                file.close()
        finally:
            for file in files:
                file.close()


def _spilled(file) -> Iterator[tuple[int, bytes, _Members]]:
    load = pickle.Unpickler(file).load
    while True:
        try:
            code, content, keys, best, size = pickle.load(file)
        except EOFError:
            return
        one = _Members()
        one.keys, one.best, one.size = keys, best, size
        yield code, content, one


def _reduced(df: DataFrame, id_col: str, text_col: str, row) -> DataFrame:
    """Member rows (key, id, first, n, hash, row); hash and row only where ``first``."""
    packed = df.select(*columns_of(df, id=id_col, text=text_col), row.alias("row"))
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            packed.schema["id"],
            T.StructField("first", T.BooleanType()),
            T.StructField("n", T.LongType()),
            T.StructField("hash", T.LongType()),
            T.StructField("row", packed.schema["row"].dataType),
        ]
    )

    return packed.mapInArrow(_reduce_batches, schema)


def _classes(reps: DataFrame, bucket_bytes: int) -> DataFrame:
    """(key, keep_key, keep_id, group_size, text_sha256) of each representative (key, id, n, hash, text)."""
    id_type = reps.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("keep_key", T.LongType()),
            T.StructField("keep_id", id_type),
            T.StructField("group_size", T.LongType()),
            T.StructField("text_sha256", T.StringType()),
        ]
    )

    def classify(batches):
        def rows():
            for content, members in grace_classes(_records(batches), bucket_bytes):
                digest = hashlib.sha256(content).hexdigest()
                keep_id, keep_key, _ = members.best
                for key in members.keys:
                    yield key, keep_key, keep_id, members.size, digest

        yield from batches_of(rows(), to_arrow_schema(schema))

    return reps.repartition("hash").mapInArrow(classify, schema)


def duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty.
    The row with the smallest id stays (null ids last; of rows with one id, one of them), so each
    class keeps exactly one row. Repeated rows are members like any others; other columns are
    ignored; an empty table gives no rows.
    """
    member = written(_reduced(df, id_col, text_col, F.struct(df[f"`{text_col}`"].alias("text"))), "grace")
    reps = member.where("first").select("key", "id", "n", "hash", F.col("row.text").alias("text"))
    classes = _classes(reps, bucket_bytes)
    kept = F.col("first") & (F.col("key") == F.col("keep_key"))
    return member.select("key", "id", "first").join(classes, "key").select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The kept rows, with all their columns as they were."""
    member = _reduced(df, id_col, text_col, whole_row(df)).where("first")
    reps = member.select("key", "id", "n", "hash", F.col("row").getField(text_col).alias("text"), "row")
    schema = T.StructType([reps.schema["row"]])

    def keep(batches):
        found = ((members.best[2],) for _, members in grace_classes(_records(batches), bucket_bytes))
        yield from batches_of(found, to_arrow_schema(schema), rows_each=256)

    return reps.repartition("hash").mapInArrow(keep, schema).select("row.*")
