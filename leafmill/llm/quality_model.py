"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import crc_mod, slices
from .text_stats import Texts

FEATURES = ("log_words", "word_length", "symbols", "capitals", "exclamations", "pipes", "dup_lines", "repeats", "distinct", "digits", "stops", "line_length")


def features(texts: Texts) -> np.ndarray:
    """Transformed counts, one row per text: logs of sizes and log odds of shares.

    Half a count on either side keeps shares of nothing finite, so an empty text has odds of 1.
    """
    odds = lambda some, rest: np.log((some + 0.5) / (np.maximum(rest, 0) + 0.5))
    words, chars = texts.n_words.astype(float), texts.word_chars.astype(float)
    n_lines, dup = texts.lines
    distinct = texts.n_distinct_words.astype(float)
    columns = [
        np.log1p(words),
        np.log((chars + 1) / (words + 1)),
        odds(texts.n_symbols, chars - texts.n_symbols),
        odds(texts.n_upper, texts.n_lower),
        odds(texts.count("!"), chars),
        odds(texts.count("|"), words),
        odds(dup, n_lines - dup),
        odds(texts.n_repeat_words, words - texts.n_repeat_words),
        # distinct words fall off with length, so they are held against its square root
        np.log((distinct + 1) / (np.sqrt(words) + 1)),
        odds(texts.count("0123456789"), chars),
        odds(texts.count(".,;:?"), chars),
        np.log((words + 1) / (n_lines + 1)),
    ]
    return np.stack(columns, axis=1)


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            f = features(Texts.of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<double>")


class Discriminant:
    """Two normal densities with shrunken covariances; factors are kept, not covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1):
        total = sum(n for n, _, _ in moments.values())
        self.prior = (moments[1][0] + 1) / (total + 2) if 1 in moments else 1 / (total + 2)
        self.classes = None
        if len(moments) < 2 or min(n for n, _, _ in moments.values()) < 2:
            return
        pooled = sum(second - n * np.outer(mean, mean) for n, mean, second in moments.values()) / total
        self.classes = {}
        for label, (n, mean, second) in moments.items():
            own = (second - n * np.outer(mean, mean)) / n
            # towards the pooled variances, more so for small classes; the floor keeps constants invertible
            weight = min(1.0, shrinkage + len(mean) / n)
            covariance = (1 - weight) * own + weight * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(mean))
            factor = np.linalg.cholesky(covariance)
            self.classes[label] = (mean, factor, -np.log(np.diag(factor)).sum())

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(f), self.prior)
        density = {}
        for label, (mean, factor, constant) in self.classes.items():
            z = np.linalg.solve(factor, (f - mean).T)
            density[label] = constant - 0.5 * (z * z).sum(axis=0)
        logit = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fits on (f, quality) rows; all of them count, as sums that Spark makes. One row per class comes back."""
    k = len(FEATURES)
    x = [F.get("f", F.lit(i)) for i in range(k)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(k)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = {}
    for row in labelled.where("quality in (0, 1)").groupBy("quality").agg(F.count("f").alias("n"), *sums, *products).collect():
        second = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        moments[int(row["quality"])] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(k)]) / row["n"], second)
    return Discriminant(moments, shrinkage)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_fold: int = 2, shrinkage: float = 0.1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from the labels of documents outside the held-out fold (crc32 of the id); a label other than
    0 or 1, or of no document, is passed over, and labels that repeat for an id count once. With fewer
    than two labelled documents of a class the score is the smoothed share of label 1. Null and empty
    texts have the features of an empty text. Repeated rows score alike; null ids have no label.
    """
    table = materialize(document_features(docs), "quality-features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)").distinct()
    train = table.where(crc_mod(F.col("doc_id"), folds) != held_fold).join(known, "doc_id")
    model = fit(train, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = model.score(f)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", "predicted")
