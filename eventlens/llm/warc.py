"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: rows are dealt out to archives of bounded size, one Spark task each. Of equal payloads of
some size only one is stored, by the smallest id; the others are revisit records that refer to it.
Archives appear under their final name when complete, so a task that runs again replaces its own.

Reading: the leading skippable frame gives the dictionary, each frame one record; version line,
mandatory headers, lengths and digests are checked, and a damaged record becomes a row with an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventlens.llm.common import batches_of, columns_of, scratch, utf8

#: The skippable frame of a dictionary, the ordinary frame of zstd, and the dictionary's own (fixed values).
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
ZSTD_DICTIONARY = 0xEC30A437

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(key) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def _key_of(urn: str | None):
    if not urn or not urn.startswith("<urn:record:") or not urn.endswith(">"):
        return None
    key = urn[12:-1]
    return None if key == "null" else key


def record(key, url: str | None, kind: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only."""
    head = HTTP_HEAD % len(payload)
    block = head if kind == "revisit" else head + payload
    target = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else record_id(key)[1:-1]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(content: bytes) -> bytes:
    """The dictionary, compressed, in a skippable frame."""
    packed = zstandard.ZstdCompressor(level=3).compress(content)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; too few or too small ones give the last bytes of them as raw content."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _loaded(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if not content:
        return None
    full = content[:4] == struct.pack("<I", ZSTD_DICTIONARY)
    return zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


class Damaged(ValueError):
    """What is wrong with an archive or record."""


#: Bytes that are given to the decompressor at once: few at first, so that little of the next frame is read and given back.
FIRST_SLICE, LAST_SLICE = 1 << 12, 1 << 20


def frames(archive: bytes) -> Iterator[bytes]:
    """The content of each frame after the leading dictionary frame; other skippable frames are passed over.

    Frames end where the decompressor says; what can't be decoded to its end is Damaged.
    """
    at, content = 0, b""
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_FRAME:
        at, content = _skippable(archive, 0)
        if content[:4] == struct.pack("<I", ZSTD_FRAME):
            try:
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            except zstandard.ZstdError as exc:
                raise Damaged(f"dictionary: {exc}") from exc
    decompressor = zstandard.ZstdDecompressor(dict_data=_loaded(content)) if content else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        if len(archive) - at >= 8 and struct.unpack_from("<I", archive, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at, _ = _skippable(archive, at)
            continue
        one, out, end, step = decompressor.decompressobj(), [], at, FIRST_SLICE
        try:
            while not one.eof and end < len(archive):
                part = view[end : end + step]
                out.append(one.decompress(part))
                end, step = end + len(part), min(2 * step, LAST_SLICE)
        except zstandard.ZstdError as exc:
            raise Damaged(f"frame at {at}: {exc}") from exc
        if not one.eof:
            raise Damaged(f"frame at {at}: cut short")
        at = end - len(one.unused_data)
        yield b"".join(out)


def _skippable(archive: bytes, at: int) -> tuple[int, bytes]:
    (size,) = struct.unpack_from("<I", archive, at + 4)
    end = at + 8 + size
    if end > len(archive):
        raise Damaged(f"skippable frame at {at}: cut short")
    return end, archive[at + 8 : end]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; Damaged if anything in it is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("no WARC version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged(f"not a header: {line[:40]!r}")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise Damaged(f"no {name}")
    if not headers["content-length"].isdigit():
        raise Damaged("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"content-length is {size}, the block has {len(rest) - 4}")
    block = rest[:size]
    _same_digest(headers.get("warc-block-digest"), block, "block")
    return headers, block


def _same_digest(stated: str | None, content: bytes, what: str) -> None:
    if stated and stated.startswith("sha256:") and stated[7:] != hashlib.sha256(content).hexdigest():
        raise Damaged(f"{what} digest differs")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length and bytes of a record's HTTP payload; a revisit has none but states its length."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lengths = [v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if n.strip().lower() == b"content-length"]
    if not gap or len(lengths) != 1 or not lengths[0].isdigit():
        raise Damaged("no HTTP content-length")
    if headers["warc-type"] == "revisit":
        if body:
            raise Damaged("a revisit with a payload")
        return int(lengths[0]), None
    if int(lengths[0]) != len(body):
        raise Damaged(f"HTTP content-length is {int(lengths[0])}, the payload has {len(body)}")
    _same_digest(headers.get("warc-payload-digest"), body, "payload")
    return len(body), body


def with_revisits(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, digest, refers_to): the smallest id of equal payloads that a row revisits, else null.

    Null payloads are empty. Payloads under ``min_bytes`` are never revisits. Rows with the id that
    others refer to are responses, repeated rows of it too; null ids are never referred to.
    """
    rows = df.select(*columns_of(df, id=id_col, url=url_col, html=html_col))
    rows = rows.select("id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    shared = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    joined = rows.join(shared, "digest", "left")
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", "digest", refers_to.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write (id, url, payload, digest, refers_to) as ``.warc.zst`` files; returns (path, records, bytes), computed lazily.

    A task rotates to a new archive after ``archive_bytes``. Its name holds the number of the
    partition, so another attempt writes the same files again. Each archive's dictionary is trained on its
    own first records, up to SAMPLE_BYTES of them.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        yield from batches_of(_write_all(_rows(batches), folder, f"{part:06d}", attempt, archive_bytes, level), _WRITTEN)

    return rows.mapInArrow(write, "path string, records long, bytes long")


_WRITTEN = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to")]
        for key, url, digest, refers_to, payload in zip(*columns, utf8(batch.column("payload"))):
            yield record(key, url, "response" if refers_to is None else "revisit", payload, digest, refers_to)


def _file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """Where the folder is, as Hadoop names it: ``file:/x``, ``file:///x``, ``/x`` or another store's address."""
    if folder.startswith("file:") or "://" not in folder:
        return arrow_fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return arrow_fs.FileSystem.from_uri(folder)


def _write_all(records: Iterator[bytes], folder: str, part: str, attempt: int, archive_bytes: int, level: int) -> Iterator[tuple[str, int, int]]:
    files, top = _file_system(folder)
    files.create_dir(top, recursive=True)
    number = 0
    records = iter(records)
    while True:
        samples, size = [], 0
        for data in records:
            samples.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                break
        if not samples:
            return
        content = train(samples)
        loaded = _loaded(content)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=loaded) if loaded else zstandard.ZstdCompressor(level=level)
        name = f"part-{part}-{number:05d}.warc.zst"
        unfinished = f"{top}/_unfinished-{name}-{attempt}"
        count = written = 0
        with files.open_output_stream(unfinished) as out:
            for frame in _frames_of(content, compressor, samples, records):
                out.write(frame)
                written += len(frame)
                count += 1
                if written >= archive_bytes and count > len(samples):
                    break
        files.move(unfinished, f"{top}/{name}")
        yield f"{folder}/{name}", count - 1, written
        number += 1


def _frames_of(content: bytes, compressor: zstandard.ZstdCompressor, samples: list[bytes], records: Iterator[bytes]) -> Iterator[bytes]:
    yield dictionary_frame(content)
    for data in samples:
        yield compressor.compress(data)
    for data in records:
        yield compressor.compress(data)


_READ = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the folder's ``.warc.zst`` files.

    ``payload_digest`` is computed from the payload; that of a revisit is the stated one. A damaged
    record gives a row with ``error`` and nulls; nothing after a damaged frame can be located, so it
    ends its archive. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_READ)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for out in batches_of(_read_one(path.as_py(), content.as_py()), schema):
                    yield out

    return files.mapInArrow(read, _READ)


def _read_one(path: str, archive: bytes) -> Iterator[tuple]:
    try:
        for data in frames(archive):
            try:
                headers, block = parse(data)
                size, payload = payload_of(headers, block)
            except Damaged as exc:
                yield path, None, None, None, None, None, None, None, str(exc)
                continue
            stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
            digest = stated if payload is None else hashlib.sha256(payload).hexdigest()
            yield path, headers["warc-type"], _key_of(headers["warc-record-id"]), _key_of(headers.get("warc-refers-to")), headers.get("warc-target-uri"), size, digest, payload, None
    except Damaged as exc:
        yield path, None, None, None, None, None, None, None, str(exc)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write all rows to archives in a new shared folder, and give the records read back."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "warc")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    write_archives(with_revisits(df, id_col, url_col, html_col), folder).write.format("noop").mode("overwrite").save()
    return read_archives(spark, folder)
