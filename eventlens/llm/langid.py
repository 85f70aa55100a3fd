"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 1 to 4 bytes of the lower-cased letters, with blanks between words, hashed to a
fixed number of embeddings. A text is the mean of its subwords' embeddings; a linear layer
and a softmax give the languages. Training is stochastic gradient descent in numpy on a bounded
sample; a held-back part of it sets the temperature of the scores and the score under which
an answer is rejected. Predicting needs the product of embeddings and layer only, one row of
scores per bucket, and reads whole texts in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import columns_of

BUCKETS = 1 << 14
DIMENSIONS = 16
LENGTHS = (1, 2, 3, 4)
#: The bound of the training sample: rows of each language, and rows of all.
ROWS_PER_LANGUAGE = 400
ROWS = 2400
EPOCHS = 12
RATE = 0.5
DECAY = 1e-4
SEED = 7
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than lower-case letters is a blank.
_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint32(2654435761)


def subword_counts(text: str | None) -> tuple[np.ndarray, int]:
    """How often each bucket occurs in a whole text, and how many subwords there are; none without a letter."""
    counts, total = np.zeros(BUCKETS, np.int64), 0
    if not text or not _LETTER.search(text):
        return counts, 0
    raw = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    longest = max(LENGTHS)
    for at in range(0, len(raw), SLICE_BYTES):
        # runs that begin in this slice, so that each counts once
        part = np.frombuffer(raw[at : at + SLICE_BYTES + longest - 1], np.uint8).astype(np.uint32)
        begin = min(SLICE_BYTES, len(raw) - at)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            usable = len(part) - n + 1
            if usable <= 0:
                break
            code = code[:usable] | (part[n - 1 :] << np.uint32(8 * (n - 1)))
            if n in LENGTHS:
                mixed = (code[:begin] + np.uint32(n * 0x9E3779)) * _MIX
                counts += np.bincount(((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                total += len(mixed)
    return counts, total


@dataclass(frozen=True)
class Model:
    """Scores per bucket (embeddings times layer), offsets, temperature and the least accepted score."""

    languages: tuple[str, ...]
    table: np.ndarray
    offset: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, counts: np.ndarray, total: int) -> np.ndarray:
        logits = (counts.astype(np.float32) @ self.table) / total + self.offset
        return _softmax(logits / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = subword_counts(text)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        p = self.probabilities(counts, total)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model from (language, buckets, counts) rows; every fifth row calibrates it.

    Rejection: the least score at which at most one in fifty accepted calibration rows is wrong.
    """
    languages = tuple(sorted({language for language, _, _ in sample}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {language: i for i, language in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer = np.zeros((DIMENSIONS, len(languages)))
    offset = np.zeros(len(languages))
    rows = [(number[language], buckets, counts / counts.sum()) for language, buckets, counts in sample]
    order = rng.permutation(len(rows))
    checks = order[::5] if len(rows) >= 10 * len(languages) else order
    learnt = np.setdiff1d(order, checks) if checks is not order else order
    steps = epochs * len(learnt)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(learnt):
            label, buckets, shares = rows[i]
            mean = shares @ embeddings[buckets]
            error = _softmax(mean @ layer + offset)
            error[label] -= 1
            step = rate * (1 - done / steps)
            back = layer @ error
            back /= max(1.0, np.linalg.norm(back))
            layer -= step * (np.outer(mean, error) + DECAY * layer)
            offset -= 0.1 * step * error
            # a bucket's share is small in a long text; all of them together move the mean by one step
            embeddings[buckets] -= step * np.outer(shares / (shares @ shares) ** 0.5, back)
            done += 1
    logits = np.array([(rows[i][2] @ embeddings[rows[i][1]]) @ layer + offset for i in checks])
    labels = np.array([rows[i][0] for i in checks])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    p = _softmax(logits / temperature)
    scores, wrong = p.max(axis=1), p.argmax(axis=1) != labels
    by_score = np.argsort(-scores, kind="stable")
    within = np.flatnonzero(np.cumsum(wrong[by_score]) <= 0.02 * np.arange(1, len(labels) + 1))
    reject_below = float(scores[by_score[within[-1]]]) if len(within) else 1.0
    return Model(languages, (embeddings @ layer).astype(np.float32), offset, temperature, reject_below)


def held_out(id_col) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0; null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of at most ``rows`` rows that are not held out, in a hashed order.

    Each language's first rows come before any language's later ones. Only sparse counts, at most
    BUCKETS a row, reach the driver, never texts.
    """
    packed = df.select(*columns_of(df, id=id_col, text=text_col, lang=lang_col))
    usable = packed.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ranked = usable.select("id", "lang", F.row_number().over(order).alias("rank")).where(F.col("rank") <= per_language)
    chosen = ranked.orderBy("rank", F.xxhash64("id", "lang")).limit(rows).select("id", "lang")
    texts = packed.join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for text in batch.column("text").to_pylist():
                found, _ = subword_counts(text)
                buckets.append(np.flatnonzero(found))
                counts.append(found[buckets[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "lang", "buckets", "counts"]
            )

    kinds = T.StructType([packed.schema["id"], packed.schema["lang"], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    found = texts.mapInArrow(count, kinds).where(F.size("buckets") > 0).limit(rows).collect()
    found.sort(key=lambda r: (str(r["id"]), r["lang"], r["buckets"]))
    return [(r["lang"], np.array(r["buckets"]), np.array(r["counts"], float)) for r in found]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return train(training_sample(df, id_col, text_col, lang_col))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (0 to 1), accepted.

    Null texts and texts without letters get ``und`` and a score of 0; so does everything if the
    model knows no language. ``accepted`` is false where the score is below the model's rejection.
    Repeated rows are predicted alike; other columns are ignored; an empty table gives no rows.
    """
    packed = df.select(*columns_of(df, id=id_col, text=text_col))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"]
            )

    kinds = T.StructType([packed.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.lit(model.reject_below))
    return packed.mapInArrow(run, kinds).select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score", accepted.alias("accepted"))
