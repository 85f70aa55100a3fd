"""Near-duplicates by SimHash and pigeonhole blocks.

A fingerprint is computed over the whole text, in slices of bounded size. Distinct fingerprints are
dealt out under block keys (chosen bits of the fingerprint); those that share a key meet in one
task, which verifies Hamming distances. A task reports a spanning forest of each bucket, never all
its pairs, so a large group of near copies costs about one link for each fingerprint. Components of the links
are found with joins (`components`), and copies are attached at the end.

Buckets beyond ``MAX_BUCKET`` fingerprints are cut into chunks of which every two meet in a task of
their own, so no link is lost and no task holds more than two chunks.

Two kinds of fingerprints:

* ``votes``: 64 bits; a bit is set if it is set in over half of the shingles' XXH64. With at most d
  differing bits, two of them share b - d of b blocks, so keys of b - d blocks find every link.
* ``projected``: 256 bits for similarities as low as 0.8, where 64 bits differ in ten or more places
  and no pigeonhole key is selective. Distinct shingles vote, signed, into a sketch whose random projections
  give the bits. Keys are seeded subsets of the bits; their number follows from the recall asked for.
  Links of these only name candidates: components of candidates bring the shingle sets together, each
  set once, and a task links those whose exact resemblance reaches the threshold (``confirmed``).
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import batches_of, columns_of, utf8, whole_row, written
from eventlens.llm.components import components
from eventlens.session import durable

SEED = 42
SLICE = 1 << 15
SKETCH = 1024
MAX_BUCKET = 4096
#: Buckets up to this size are compared by shifting whole batches, larger ones one by one.
SMALL_BUCKET = 128
#: Shingle sets, and bytes of them, in each chunk of a group of candidates; a task holds two chunks.
GROUP_ROWS = 2048
GROUP_BYTES = 8 << 20
#: Fingerprints that a block key should bring together on average, at most.
MEAN_BUCKET = 64


def shingle_hashes(text: bytes, words_each: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a whole text, at most SLICE at a time.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text of fewer words is
    one shingle, and one without words none.
    """
    words = text.lower().split()
    if not words:
        return
    if len(words) <= words_each:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(words_each))))
    while len(part := np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, SLICE), itertools.repeat(SEED)), np.uint64)):
        yield part


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words_each)]))


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = (256 * np.arange(8)).astype(np.int64)


def votes(text: bytes, words_each: int) -> bytes:
    """The 64-bit fingerprint, most significant byte first; zero for a text without words."""
    counts, total = np.zeros(2048, np.int64), 0
    for hashes in shingle_hashes(text, words_each):
        places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS
        counts += np.bincount(places.ravel(), minlength=2048)
        total += len(hashes)
    ones = (counts.reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    return np.packbits(2 * ones > total, bitorder="little").tobytes()[::-1]


@cache
def _projection(bits: int) -> np.ndarray:
    """Rounded normal variates: no ties as with signs, and sums that float32 holds exactly, in any order."""
    drawn = np.random.default_rng(SEED).normal(0, 32, (SKETCH, bits))
    return np.clip(np.rint(drawn), -127, 127).astype(np.float32)


def projected(texts: list[bytes], words_each: int, bits: int = 256) -> list[bytes]:
    """Sign bits of random projections of the signed distinct shingles, zero without words; and a 128-bit digest of the set."""
    sketch, digests = np.zeros((len(texts), SKETCH), np.float32), []
    for row, text in enumerate(texts):
        hashes = shingle_set(text, words_each)
        sign = ((hashes >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
        sketch[row] = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), sign, SKETCH)
        digests.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
    packed = np.packbits(sketch @ _projection(bits) > 0, axis=1)
    return [x.tobytes() + d for x, d in zip(packed, digests)]


@dataclass(frozen=True)
class Linking:
    """How fingerprints are made and which of them link.

    ``keys`` gives the bit positions of each block key for a number of distinct fingerprints. With a
    ``similarity``, links are candidates, and shingle sets of at least that resemblance link; what follows
    the ``bits`` in a fingerprint then tells sets apart.
    """

    words_each: int
    bits: int
    distance: int
    keys: Callable[[int], list[tuple[int, ...]]]
    fingerprints: Callable[[list[bytes], int], list[bytes]]
    similarity: float | None = None


def pigeonhole_keys(distance: int, bits: int = 64) -> Callable[[int], list[tuple[int, ...]]]:
    """Keys of b - distance out of b blocks: every pair within ``distance`` shares one.

    More blocks make longer, more selective keys; b is the least that keeps buckets small on average.
    """

    def keys(n: int) -> list[tuple[int, ...]]:
        for b in range(distance + 1, distance + 6):
            edges = [round(i * bits / b) for i in range(b + 1)]
            blocks = [range(edges[i], edges[i + 1]) for i in range(b)]
            chosen = [tuple(itertools.chain(*c)) for c in itertools.combinations(blocks, b - distance)]
            if n >> min(len(c) for c in chosen) <= MEAN_BUCKET:
                break
        return chosen

    return keys


def found_share(differing: float, distance: int, length: int, tables: int, bits: int = 256) -> float:
    """The chance that two fingerprints link whose bits differ with probability ``differing`` each.

    They must differ in at most ``distance`` bits and agree on all bits of one of the keys. All keys see the
    same differing bits, so the chance is taken for each number of those and then averaged.
    """
    total = 0.0
    for d in range(min(distance, bits - length) + 1):
        ways = math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1)
        odds = math.exp(ways + d * math.log(differing) + (bits - d) * math.log(1 - differing))
        agree = math.prod((bits - d - i) / (bits - i) for i in range(length))
        total += odds * (1 - (1 - agree) ** tables)
    return total


def sampled_keys(differing: float, recall: float, distance: int, bits: int = 256) -> Callable[[int], list[tuple[int, ...]]]:
    """Seeded bit subsets, as many as make fingerprints whose bits differ with probability ``differing`` link with probability ``recall``.

    They grow longer with the number of fingerprints, so that buckets stay small, and then more of them are needed.
    """
    if found_share(differing, distance, 12, 1 << 30, bits) < recall:
        raise ValueError(f"a distance of {distance} is too small for a recall of {recall}")

    def keys(n: int) -> list[tuple[int, ...]]:
        length = max(12, math.ceil(math.log2(max(n, 1) / MEAN_BUCKET)))
        tables = bisect.bisect_left(range(1 << 20), recall, key=lambda t: found_share(differing, distance, length, t, bits))
        rng = np.random.default_rng(SEED)
        return [tuple(int(x) for x in rng.choice(bits, length, replace=False)) for _ in range(tables)]

    return keys


def hamming_linking(words_each: int = 3, distance: int = 3) -> Linking:
    """64-bit votes linked at up to ``distance`` differing bits; every link is found."""
    return Linking(words_each, 64, distance, pigeonhole_keys(distance), lambda texts, k: [votes(t, k) for t in texts])


def similar_linking(words_each: int = 5, similarity: float = 0.8, recall: float = 0.99) -> Linking:
    """Projected fingerprints for a resemblance (Jaccard) of shingles of at least ``similarity``.

    Sets of resemblance J have a cosine of at least 2J / (1 + J), and bits differ with probability
    arccos(cosine) / pi. The bound on differing bits lies three and a half standard deviations above that mean.
    ``recall`` is the chance that a pair right at the threshold becomes a candidate, whatever the number of
    fingerprints; it rises quickly with the resemblance. What the candidates resemble is computed exactly.
    """
    bits = 256
    differing = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    distance = round(bits * differing + 3.5 * math.sqrt(bits * differing * (1 - differing)))
    keys = sampled_keys(differing, recall, distance, bits)
    return Linking(words_each, bits, distance, keys, lambda texts, k: projected(texts, k, bits), similarity)


def fingerprints(df: DataFrame, how: Linking, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, fp) of each input row: the text's SHA-256 and its fingerprint; narrow, and written once."""
    packed = _texts(df, id_col, text_col)
    schema = T.StructType([packed.schema["id"], packed.schema["digest"], T.StructField("fp", T.BinaryType())])

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = pa.array(how.fingerprints(utf8(part.column("text")), how.words_each), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), prints], names=["id", "digest", "fp"])

    return written(packed.mapInArrow(made, schema), "simhash")


def _digest(text) -> F.Column:
    """Binary SHA-256; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _blocks(prints: pa.Array, keys: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """For each key the bucket of every fingerprint."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1)
    bits = np.unpackbits(raw, axis=1).astype(np.uint64)
    for number, places in enumerate(keys):
        block = (bits[:, places] * (np.uint64(1) << np.arange(len(places), dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
        yield ((block + np.uint64(number)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(number << 48)).view(np.int64)


def links(prints: DataFrame, how: Linking, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): for every bucket of the distinct fingerprints ``fp``, links that connect what is linked in it."""
    n = prints.count()
    keys = how.keys(n)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.column("fp").slice(at, 2048)
                for mixed in _blocks(part, keys):
                    yield pa.RecordBatch.from_arrays([pa.array(mixed, pa.int64()), part], names=["bucket", "fp"])

    rows = prints.select("fp").mapInArrow(dealt, "bucket long, fp binary")
    large = durable(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket))
    rows = _cut(rows, large.select("bucket", F.ceil(F.col("n") / max_bucket).cast("int").alias("cut")))
    distance = how.distance

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(_bucket_links(batches, distance), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verified, "a binary, b binary")


def _cut(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of the buckets in ``large`` dealt out again so that every two of a bucket's ``cut`` chunks meet in one of its own."""
    if large.isEmpty():
        return rows
    sized = rows.join(large, "bucket", "left")
    cut = F.col("cut")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), cut).cast("int")
    every = F.transform(F.sequence(F.lit(0), cut - 1), lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
    met = F.when(cut.isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(every)
    others = [c for c in rows.columns if c != "bucket"]
    dealt = sized.select("bucket", *others, F.explode(met).alias("m"))
    return dealt.select(F.xxhash64("bucket", "m.i", "m.j").alias("bucket"), *others)


def _bucket_links(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[tuple[bytes, bytes]]:
    """Links within the runs of one bucket; a run may continue in the next batch."""
    buckets, prints = np.empty(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
        buckets = np.concatenate([buckets, batch.column("bucket").to_numpy()])
        prints = new if prints is None else np.concatenate([prints, new])
        open_from = int(np.searchsorted(buckets, buckets[-1]))
        yield from _linked(buckets[:open_from], prints[:open_from], distance)
        buckets, prints = buckets[open_from:], prints[open_from:]
    if len(buckets):
        yield from _linked(buckets, prints, distance)


def _linked(buckets: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple[bytes, bytes]]:
    if not len(buckets):
        return
    raw = prints.astype(">u8")
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(buckets)])
    number = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(sizes[number] <= SMALL_BUCKET)
    pairs = []
    for shift in range(1, SMALL_BUCKET):
        at = at[at < len(buckets) - shift]
        at = at[number[at + shift] == number[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + shift]).sum(axis=1) <= distance]
        pairs.append(np.stack([near, near + shift]))
    found = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    # a bucket with many pairs gives a forest too
    dense = (sizes > SMALL_BUCKET) | (np.bincount(number[found[0]], minlength=len(sizes)) > 2 * sizes)
    for i, j in found[:, ~dense[number[found[0]]]].T:
        yield raw[i].tobytes(), raw[j].tobytes()
    for start, size in zip(starts[dense], sizes[dense]):
        # from the smallest on, so that keys that bring the same together give the same links
        at = start + np.lexsort(prints[start : start + size].T[::-1])
        for i, j in _forest(prints[at], distance):
            yield raw[at[i]].tobytes(), raw[at[j]].tobytes()


def _forest(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links, breadth first: each step leaves out what it has reached."""
    left = np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= distance
            for other in left[near]:
                yield at, other
            queue.extend(left[near])
            left = left[~near]


def confirmed(prints: DataFrame, texts: DataFrame, how: Linking, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links between the fingerprints of shingle sets of at least ``how.similarity``, exactly computed.

    ``prints``: (fp, best) with the (id, digest) of a text of that set; ``texts``: (id, digest, text).
    Candidates by Hamming distance and texts of equal bits but other sets come together by components. Two sets of a
    component link if they share a block key and resemble each other, whatever the size of the component: in
    one task if it is small, chunk against chunk, or block by block if it has more chunks than there are keys.
    """
    bits = F.substring("fp", 1, how.bits // 8)
    sketches = durable(prints.groupBy(bits.alias("fp")).agg(F.count("*").alias("n")))
    same = sketches.where("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    # hashes do here, and are short: a collision only brings more sets together
    edges = links(sketches, how, max_bucket).union(same).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    coarse = components(edges).select(F.col("node").alias("bits"), F.col("component").alias("bucket"))
    near = prints.withColumn("bits", F.xxhash64(bits)).join(coarse, "bits")
    near = durable(near.select("bucket", "fp", F.col("best.id").alias("mine"), F.col("best.digest").alias("sha")))
    found = texts.join(near, (F.col("sha") == F.col("digest")) & F.col("mine").eqNullSafe(F.col("id"))).select("bucket", "fp", "text")
    words_each, similarity = how.words_each, how.similarity

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = pa.array([shingle_set(t, words_each).tobytes() for t in utf8(part.column("text"))], pa.binary())
                sizes = pa.array([len(x) for x in sets.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("fp"), sizes, sets], names=["bucket", "fp", "size", "shingles"])

    sets = written(found.mapInArrow(made, "bucket long, fp binary, size long, shingles binary"), "shingles")
    cut = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("size") / GROUP_BYTES)).cast("int").alias("cut")
    large = durable(sets.groupBy("bucket").agg(cut).where("cut > 1"))
    keys = how.keys(sketches.count())
    wide = large.where(F.col("cut") > len(keys))
    if not wide.isEmpty():
        by_key = _by_key(sets.join(wide, "bucket", "left_semi"), keys, how.bits // 8)
        sets = sets.join(wide, "bucket", "left_anti").union(by_key)
        large = durable(sets.groupBy("bucket").agg(cut).where("cut > 1"))

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(_set_links(batches, similarity, keys, how.bits // 8), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    met = _cut(sets, large).select("bucket", "fp", "shingles").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return met.mapInArrow(verified, "a binary, b binary")


def _by_key(sets: DataFrame, keys: list[tuple[int, ...]], size: int) -> DataFrame:
    """The sets once for each block key, in that key's bucket of their component."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bits = pa.array([x[:size] for x in part.column("fp").to_pylist()], pa.binary())
                found = pa.array(np.stack(list(_blocks(bits, keys)), axis=1).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "blocks"])

    named = sets.select("bucket", "fp", "size", "shingles").mapInArrow(blocks, "bucket long, fp binary, size long, shingles binary, blocks array<long>")
    dealt = named.select("bucket", "fp", "size", "shingles", F.explode("blocks").alias("block"))
    return dealt.select(F.xxhash64("bucket", "block").alias("bucket"), "fp", "size", "shingles")


def _masks(keys: list[tuple[int, ...]], bits: int) -> np.ndarray:
    """For each key its bits, as the words of a fingerprint."""
    chosen = np.zeros((len(keys), bits), np.uint8)
    for row, places in zip(chosen, keys):
        row[list(places)] = 1
    return np.packbits(chosen, axis=1).view(np.uint64)


def _set_links(batches: Iterable[pa.RecordBatch], similarity: float, keys: list[tuple[int, ...]], size: int) -> Iterator[tuple[bytes, bytes]]:
    """Links within the runs of one bucket; repeated rows of a fingerprint follow each other and count once."""
    masks = _masks(keys, 8 * size)

    def linked(names: list[bytes], sets: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        if len(names) > 1:
            prints = np.frombuffer(b"".join(n[:size] for n in names), np.uint64).reshape(len(names), -1)
            yield from _resembling(names, sets, similarity, prints, masks)

    now, names, sets = None, [], []
    for batch in batches:
        for bucket, fp, shingles in zip(*(batch.column(c).to_pylist() for c in ("bucket", "fp", "shingles"))):
            if bucket != now:
                yield from linked(names, sets)
                now, names, sets = bucket, [], []
            if not names or names[-1] != fp:
                names.append(fp)
                sets.append(shingles)
    yield from linked(names, sets)


def _resembling(names: list[bytes], sets: list[bytes], similarity: float, prints: np.ndarray | None = None, masks: np.ndarray | None = None) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of sets (ordered uint64) whose resemblance is at least ``similarity``; empty sets link to none.

    With ``prints``, the fingerprints, only pairs that agree on all bits of one of the ``masks`` count.
    """
    order = sorted((i for i in range(len(sets)) if sets[i]), key=lambda i: len(sets[i]))
    if len(order) < 2:
        return
    if prints is not None:
        prints = prints[order]
    sizes = np.array([len(sets[i]) // 8 for i in order])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, shingles = np.unique(np.frombuffer(b"".join(sets[i] for i in order), np.uint64), return_inverse=True)
    mark = np.zeros(int(shingles.max()) + 1, np.int32)
    left = np.ones(len(order), bool)
    for root in range(len(order)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            # only sets of a size that allows the resemblance
            low = int(np.searchsorted(sizes, sizes[at] * similarity - 1e-6))
            high = int(np.searchsorted(sizes, sizes[at] / similarity + 1e-6, "right"))
            rest = low + np.flatnonzero(left[low:high])
            if not len(rest):
                continue
            low, high = int(rest[0]), int(rest[-1]) + 1
            own = shingles[starts[at] : ends[at]]
            mark[own] = 1
            shared = np.add.reduceat(mark[shingles[starts[low] : ends[high - 1]]], starts[low:high] - starts[low])[rest - low]
            mark[own] = 0
            near = rest[shared >= similarity * (sizes[rest] + sizes[at] - shared) - 1e-9]
            if prints is not None and len(near):
                differ = prints[near] ^ prints[at]
                shares = np.zeros(len(near), bool)
                for mask in masks:
                    shares |= ~(differ & mask).any(axis=1)
                    if shares.all():
                        break
                near = near[shares]
            for other in near:
                yield names[order[at]], names[order[other]]
            left[near] = False
            queue.extend(near.tolist())


def _grouped(rows: DataFrame, how: Linking, max_bucket: int, texts: DataFrame) -> DataFrame:
    """(fp, best): the smallest (id, digest) of the group of each distinct fingerprint; null ids last."""
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("digest"))
    prints = durable(rows.groupBy("fp").agg(F.min(own).alias("best")))
    edges = links(prints, how, max_bucket) if how.similarity is None else confirmed(prints, texts, how, max_bucket)
    found = components(edges).select(F.col("node").alias("fp"), "component")
    placed = durable(prints.join(found, "fp", "left").select("fp", "best", "component"))
    linked = placed.where("component is not null")
    least = linked.groupBy("component").agg(F.min("best").alias("best"))
    joined = linked.select("fp", "component").join(least, "component").select("fp", "best")
    return placed.where("component is null").select("fp", "best").union(joined)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(*columns_of(df, id=id_col, text=text_col), _digest(F.col(f"`{text_col}`")).alias("digest"))


def near_duplicates(df: DataFrame, how: Linking, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: id, fp (binary), component_id (smallest id reachable over links).

    Null texts count as empty; texts without words have a fingerprint of zero and link like any
    others. Null ids are smaller than none: a component has a null id only if all its ids are null.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = fingerprints(df, how, id_col, text_col)
    groups = _grouped(rows, how, max_bucket, _texts(df, id_col, text_col))
    return rows.select("id", "fp").join(groups, "fp").select("id", "fp", F.col("best.id").alias("component_id"))


def keep_one_of_each(df: DataFrame, how: Linking, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """The row with the smallest id of each component, with all its columns; of equal ids one row.

    The row is found again by its id and its text's digest; rows that agree in both are one for the
    links, and one of them stays.
    """
    rows = fingerprints(df, how, id_col, text_col)
    own = F.struct(F.col("best.id").alias("id"), F.col("best.digest").alias("digest"))
    winners = _grouped(rows, how, max_bucket, _texts(df, id_col, text_col)).select(own.alias("best")).distinct().select("best.*")
    packed = df.select(whole_row(df).alias("row"), F.col(f"`{id_col}`").alias("mine"), _digest(F.col(f"`{text_col}`")).alias("sha"))
    same = (F.col("sha") == F.col("digest")) & F.col("mine").eqNullSafe(F.col("id"))
    kept = packed.join(winners, same, "left_semi")
    twins = durable(rows.groupBy("id", "digest").count().where("count > 1").select("id", "digest"))
    if not twins.isEmpty():
        kept = kept.join(twins, same, "left_anti").union(kept.join(twins, same, "left_semi").dropDuplicates(["mine", "sha"]))
    return kept.select("row.*")
