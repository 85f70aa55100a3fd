"""Documents to token ids: quality, exact copies, near copies, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
next one's documents. All but the last return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import bpe, decontaminate, exact_dedup, quality, simhash
from eventlens.llm.common import ship, table, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, by their text and their source's and language's record.

    Null texts count as empty; null sources and languages are groups of their own.
    """
    ship(spark)
    return quality.judged(docs, table(spark, sf_dir, "labels")).where("accepted").select("row.*")


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id; null texts count as empty."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that resemble each other in five-word shingles by 0.8 or more, the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one_of_each(docs, simhash.similar_linking(words_each=5, similarity=0.8))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out, and documents dropped that consist of them by more than half.

    ``n_chars``, if it is there, follows the text where that changed.
    """
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), count_col="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids``, ``n_tokens``, and ``intact``: the ids decode to the very text.

    Columns of these names are replaced; null texts have no ids and count as empty.
    """
    ship(spark)
    made = ("ids", "n_tokens", "intact")
    text = "decoded"
    while text in [c.lower() for c in docs.columns]:
        text += "_"
    decoded = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, out_col=text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    intact = F.col(text) == F.coalesce("text", F.lit(""))
    return decoded.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), intact.alias("intact"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", token_ids),
]

#: Training a classifier, SimHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
