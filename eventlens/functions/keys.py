"""Content hashes, deterministic surrogate keys and author pseudonyms."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64  # SHA-256 block size in bytes


def natural_key(*parts: Column) -> Column:
    """Colon-joined natural key; any NULL part makes the key NULL."""
    texts = [p.cast("string") for p in parts]
    joined = texts[0]
    for t in texts[1:]:
        joined = F.concat(joined, F.lit(":"), t)
    return joined


def md5_uuid(*parts: Column) -> Column:
    """MD5 of the natural key in UUID form, so re-runs reproduce the same surrogate key."""
    return F.regexp_replace(
        F.md5(natural_key(*parts)),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def multiset_hash(item: Column) -> Column:
    """Aggregate: SHA-256 fingerprint of a multiset of item texts, whatever their order.

    Every item is hashed on its own, its digest is cut in four 64-bit words, and each
    word is summed exactly. Sums combine map-side, so a group of any size is
    fingerprinted without bringing its items together. Put the rank into the item text
    to fingerprint an ordered list.
    """
    digest = F.sha2(item, 256)
    words = [
        F.sum(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    text = F.concat_ws(":", F.count(item).cast("string"), *[w.cast("string") for w in words])
    return F.sha2(text, 256)


def salt_table(spark: SparkSession, secrets: dict[str, bytes]) -> DataFrame:
    """HMAC pads per salt version. Kept as rows, not literals, so no plan prints them."""
    rows = {"salt_version_id": [], "_inner": [], "_outer": []}
    for version, secret in secrets.items():
        key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
        key = key.ljust(_BLOCK, b"\0")
        rows["salt_version_id"].append(version)
        rows["_inner"].append(bytes(b ^ 0x36 for b in key))
        rows["_outer"].append(bytes(b ^ 0x5C for b in key))
    return spark.createDataFrame(pa.table(rows))


def pseudonymise(df: DataFrame, author: str, secrets: dict[str, bytes], out: str = "author_hash") -> DataFrame:
    """HMAC-SHA256 of `author` under the row's `salt_version_id`; a missing author stays NULL.

    The salt table holds one row per configured secret, hence the broadcast.
    """
    salted = df.join(F.broadcast(salt_table(df.sparkSession, secrets)), "salt_version_id", "left")
    message = F.col(author).cast("string").cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.col("_inner"), message), 256))
    return salted.withColumn(out, F.sha2(F.concat(F.col("_outer"), inner), 256)).drop("_inner", "_outer")
