"""Quality classification by hierarchical empirical Bayes.

A logistic regression on features of the whole text, trained in numpy on a bounded sample of labelled rows,
says how likely a document is good. Labels, and these probabilities where there is no label, are
evidence on the document's site: aggregated by host and by path, they give posteriors that shrink
sparse paths toward their host and sparse hosts toward all documents, as strongly as the spread
between sites calls for. A document's own evidence is taken out of its site's before the two are combined,
so it counts once. Sites are joined as a table; Spark broadcasts it only where its files are small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import columns_of, make_room, utf8, whole_row, written

#: The bound of the training sample: the labelled rows that come first in a hashed order.
TRAINING_ROWS = 6000
THRESHOLD = 0.5
RIDGE = 1.0
#: Least and greatest share of the variance that lies between sites.
SPREAD = (1e-4, 0.5)

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
#: ASCII marks that running prose seldom has.
_MARKS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~", np.uint8)
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "bars", "exclamations", "other_punctuation", "beyond_ascii",
    "distinct_words", "top_word", "upper_words", "distinct_lines", "words_per_line", "short",
)


def features(text: bytes) -> list[float]:
    """What the classifier sees of a whole text; an empty one is all zeros but for ``short``."""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(words), len(text)
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = bytes_of[_UPPER].sum() + bytes_of[_LOWER].sum() + bytes_of[128:].sum()
    kinds = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    lines = text.split(b"\n")
    per = 1 / size
    return [
        float(np.log1p(n)),
        float(letters / n),
        float(bytes_of[_UPPER].sum() / max(1, letters)),
        float(bytes_of[48:58].sum() * per),
        float(bytes_of[_MARKS].sum() * per),
        float(bytes_of[124] * per),
        float(bytes_of[33] * per),
        float((bytes_of[34:48].sum() + bytes_of[58:64].sum() - bytes_of[35:39].sum()) * per),
        float(bytes_of[128:].sum() * per),
        len(kinds) / n**0.8,
        max(kinds.values()) / n,
        sum(c for w, c in kinds.items() if len(w) > 1 and w.isupper()) / n,
        len(set(lines)) / len(lines),
        min(50.0, n / len(lines)),
        float(n < 5),
    ]


@dataclass(frozen=True)
class Classifier:
    """Standardised features, weights and an offset; ``base`` is the share of good rows it was trained on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        z = np.column_stack([np.ones(len(x)), x, x**2]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def train(rows: np.ndarray, labels: np.ndarray) -> Classifier | None:
    """Ridge logistic regression on the features and their squares by Newton's steps; None if there is one class only."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.clip((rows - mean) / scale, -8, 8)
    x = np.column_stack([np.ones(len(x)), x, x**2])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[0, 0] = 0
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -20, 20)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(weights)), x.T @ (labels - p) - ridge @ weights)
        weights += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, weights, float(labels.mean()))


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) with label 0 or 1; of repeated ids the lower label counts; nulls are left out."""
    rows = labels.select(*columns_of(labels, id=id_col, label=label_col)).where("id is not null and label in (0, 1)")
    return rows.groupBy("id").agg(F.min("label").cast("double").alias("label"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Classifier | None:
    """The classifier from at most ``rows`` labelled documents; only their features reach the driver."""
    chosen = labelled(labels, id_col).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = df.select(*columns_of(df, id=id_col, text=text_col)).join(F.broadcast(chosen), "id")
    kinds = T.StructType([texts.schema["id"], T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            x = pa.array([features(t) for t in utf8(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), x], names=["id", "label", "x"])

    found = texts.mapInArrow(run, kinds).limit(rows).collect()
    found.sort(key=lambda r: (r["id"], r["x"]))
    return train(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["label"] for r in found]))


def scored(df: DataFrame, classifier: Classifier | None, id_col: str, text_col: str, host_col: str, path_col: str, row: Column) -> DataFrame:
    """(row, id, host, path, p): the classifier's probability; without a classifier one half."""
    packed = df.select(row.alias("row"), *columns_of(df, id=id_col, text=text_col, host=host_col, path=path_col))
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    kinds = T.StructType([packed.schema["row"], packed.schema["id"], packed.schema["host"], packed.schema["path"], T.StructField("p", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            if shared.value is None or not batch.num_rows:
                p = np.full(batch.num_rows, 0.5)
            else:
                p = shared.value.probability(np.array([features(t) for t in utf8(batch.column("text"))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "host", "path")), pa.array(p, pa.float64())], names=["row", "id", "host", "path", "p"])

    return packed.mapInArrow(run, kinds)


def _strength(spread: float, total: float, squares: float, groups: float, mean: float) -> float:
    """Prior strength from the weighted squares of group means around their parents' (method of moments)."""
    noise = mean * (1 - mean)
    free = total - squares - groups
    share = (spread / noise - groups) / free if noise > 0 and free > 0 else SPREAD[0]
    share = min(max(share, SPREAD[0]), SPREAD[1])
    return 1 / share - 1


@dataclass(frozen=True)
class Sites:
    """One row per (host, path): its sums, its host's posterior; and the two strengths and the global mean."""

    table: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def sites(rows: DataFrame) -> Sites:
    """Posteriors of hosts and paths from (host, path, evidence); null hosts and paths are sites like others."""
    paths = written(rows.groupBy("host", "path").agg(F.sum("evidence").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    mean = hosts.agg((F.sum("hs") / F.sum("hn")).alias("m")).first()["m"]
    if mean is None:
        return Sites(paths.withColumns({"hs": F.col("s"), "hn": F.col("n")}), 0.5, 1.0, 1.0)
    n, m = F.col("hn"), F.col("hs") / F.col("hn")
    h = hosts.agg(F.sum(n * (m - mean) ** 2).alias("d"), F.sum(n).alias("n"), F.sum(n * n).alias("q"), F.count("*").alias("c")).first()
    host_strength = _strength(h["d"], h["n"], h["q"] / h["n"], h["c"] - 1, mean)
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    within = F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2
    p = joined.agg(F.sum(within).alias("d"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("q"), F.count("*").alias("c")).first()
    path_strength = _strength(p["d"], h["n"], p["q"], p["c"] - h["c"], mean)
    return Sites(written(joined, "sites"), mean, host_strength, path_strength)


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def judged(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
    row: Column | None = None,
) -> DataFrame:
    """(row, host, path, p_text, p_host, p_path, p_good, accepted) of every input row.

    p_text: the classifier alone; p_host and p_path: the site's posterior means without the row's own
    evidence, its label or else p_text; p_good: both combined; accepted: p_good of at least ``threshold``. A null text counts as empty;
    null hosts and paths are sites of their own. Without labels of both kinds every p_text is one half and
    all rows are accepted. Repeated rows are judged alike; an empty table gives no rows.
    """
    classifier = fit(df, labels, id_col, text_col)
    names = (id_col, text_col, host_col, path_col)
    # texts are read and scored twice, which is cheaper than to write them between the two passes
    slim = scored(df, classifier, *names, F.lit(True)).drop("row")
    rows = scored(df, classifier, *names, row if row is not None else whole_row(df))
    known = labelled(labels, id_col).withColumnRenamed("id", "labelled_id")
    told = lambda scores: scores.join(known, F.col("id") == F.col("labelled_id"), "left").withColumn("evidence", F.coalesce("label", "p"))
    found = sites(told(slim).select("host", "path", "evidence"))
    table = found.table.withColumnsRenamed({"host": "h", "path": "q"})
    at = told(rows).join(table, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    p_host = (F.col("hs") - F.col("evidence") + found.host_strength * found.mean) / (F.col("hn") - 1 + found.host_strength)
    p_path = (F.col("s") - F.col("evidence") + found.path_strength * F.col("p_host")) / (F.col("n") - 1 + found.path_strength)
    bounded = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    at = at.withColumn("p_host", bounded(p_host)).withColumn("p_path", bounded(p_path))
    logit = _logit(F.col("p")) + _logit(F.col("p_path")) - _logit(F.lit(found.mean))
    at = at.withColumn("p_good", 1 / (1 + F.exp(-logit)))
    accepted = F.lit(True) if classifier is None else F.col("p_good") >= threshold
    return at.select("row", "host", "path", F.col("p").alias("p_text"), "p_host", "p_path", "p_good", accepted.alias("accepted"))
