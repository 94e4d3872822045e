"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, whole

FEATURES = (
    "log_bytes", "log_words", "log_word_length", "upper", "digits", "marks", "other_marks", "non_ascii", "log_line_length",
    "distinct_words", "distinct_lines", "common_line", "capital_words", "sentence_ends", "entropy",
)
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_SPACE = np.isin(_BYTE, list(b" \t\n\r\x0b\x0c"))
_PLAIN = np.isin(_BYTE, list(b".,;:'\"-!?"))
_END = np.isin(_BYTE, list(b".!?"))
_MARK = ~(_DIGIT | _LETTER | _SPACE)


def statistics(text: bytes) -> list[float]:
    """The features of a whole text, transformed to be nearer to normal: logs of sizes, roots of shares."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words, lines = text.split(), text.split(b"\n")
    many = max(1, len(words))
    share = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + len(line)
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / many)),
        root(counts[_UPPER].sum() / n),
        root(counts[_DIGIT].sum() / n),
        root(counts[_MARK & _PLAIN].sum() / n),
        root(counts[_MARK & ~_PLAIN].sum() / n),
        root(counts[128:].sum() / n),
        float(np.log1p(len(text) / len(lines))),
        root(len(set(words)) / many),
        root(len(seen) / len(lines)),
        root(max(seen.values()) / n),
        root(sum(map(bytes.istitle, words)) / many),
        root(counts[_END].sum() / many),
        float(-(share * np.log2(share)).sum()) if len(text) else 0.0,
    ]


class Discriminant:
    """Class means and shrunken covariances, with the Cholesky factors' inverses cached for scoring.

    A class covariance is shrunk towards the pooled one by `shrink`, and that towards its diagonal by `ridge`.
    """

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.5, ridge: float = 0.05):
        """`moments`: of each class (0 and 1) its count, sums and sums of products."""
        size = len(FEATURES)
        self.known = all(moments.get(k, (0,))[0] > 0 for k in (0, 1))
        if not self.known:
            self.share = 1.0 if moments.get(1, (0,))[0] > 0 else 0.0 if moments.get(0, (0,))[0] > 0 else 0.5
            return
        total = sum(m[0] for m in moments.values())
        mean = {k: m[1] / m[0] for k, m in moments.items()}
        cov = {k: m[2] / m[0] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(m[0] / total * cov[k] for k, m in moments.items())
        pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(size)
        self.parts = []
        for k in (0, 1):
            own = shrink + (1 - shrink) * size / (size + moments[k][0])
            factor = np.linalg.cholesky((1 - own) * cov[k] + own * pooled)
            constant = np.log(moments[k][0] / total) - np.log(np.diag(factor)).sum()
            self.parts.append((mean[k], np.linalg.inv(factor).T, constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of log densities (half squared Mahalanobis distances)."""
        if not self.known:
            return np.full(len(x), self.share)
        low, high = (c - 0.5 * (((x - m) @ inverse) ** 2).sum(axis=1) for m, inverse, c in self.parts)
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, stats (array of double, FEATURES). A null text counts as empty."""
    rows = whole(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(measure, schema)


#: Shrinkages to choose from, and the folds of the training rows that choose.
SHRINKS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
FOLDS = 4
Moments = dict[int, tuple[float, np.ndarray, np.ndarray]]


def _moments(labelled: DataFrame) -> dict[int, Moments]:
    """By fold and label the count, sums and sums of products, summed in Spark: what reaches the driver has the size of
    a covariance matrix."""
    size = len(FEATURES)
    item = [F.get("stats", F.lit(i)) for i in range(size)]
    sums = [F.sum(x) for x in item] + [F.sum(item[i] * item[j]) for i in range(size) for j in range(i, size)]
    moments: dict[int, Moments] = {}
    for row in labelled.groupBy("fold", "label").agg(F.count(F.lit(1)), *sums).collect():
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = row[3 + size :]
        moments.setdefault(row[0], {})[row[1]] = (row[2], np.array(row[3 : 3 + size]), upper + np.triu(upper, 1).T)
    return moments


def _sum(parts: list[Moments]) -> Moments:
    found: Moments = {}
    for part in parts:
        for label, own in part.items():
            found[label] = tuple(x + y for x, y in zip(found[label], own, strict=True)) if label in found else own
    return found


def log_loss(score: np.ndarray, label: np.ndarray) -> float:
    right = np.where(label == 1, score, 1 - score)
    return float(-np.log(np.clip(right, 1e-12, 1)).sum())


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", shrink: float | None = None) -> Discriminant:
    """Learn from all labelled rows. Without a given shrinkage the one is taken that has the least log loss over the
    folds of these rows, each scored by a model of the others; of equal ones the largest."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    fold = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5), F.lit(FOLDS)).cast("int")
    labelled = stored(stats.join(known, "doc_id").select("stats", "label", fold.alias("fold")))
    moments = _moments(labelled)
    whole_ = _sum(list(moments.values()))
    if shrink is not None:
        return Discriminant(whole_, shrink)
    models = {k: [Discriminant(_sum([m for j, m in moments.items() if j != k]), x) for x in SHRINKS] for k in moments}

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            label, own = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            loss = [sum(log_loss(models[k][i].score(x[own == k]), label[own == k]) for k in np.unique(own)) for i in range(len(SHRINKS))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(SHRINKS)), pa.int32()), pa.array(loss, pa.float64())], names=["at", "loss"])

    losses = labelled.mapInArrow(lose, "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()
    best = min(losses, key=lambda r: (round(r.loss, 6), -r["at"]), default=None)
    return Discriminant(whole_, SHRINKS[best["at"]] if best else SHRINKS[-1])


def quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 where score >= threshold).

    Labels are taken from rows of `labels` where `train`, a condition on its identifier, holds; those rows also choose
    the shrinkage, by folds. Whole texts are
    measured; null and empty texts have the statistics of an empty text and a score like any other. Without labels of
    both classes the score is the share of label 1 (0.5 without any). A document that is labelled twice counts twice;
    null and repeated identifiers are given back as they are. An empty table gives an empty result; other columns are
    ignored.
    """
    stats = stored(document_statistics(docs, id_col=id_col, text_col=text_col))
    model = fit(stats, labels.where(train), id_col=id_col)
    schema = T.StructType(
        [stats.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            found = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names
            )

    return stats.mapInArrow(score, schema)
