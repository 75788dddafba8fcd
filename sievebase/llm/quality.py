"""Quality classifier: regularised quadratic discriminant over document statistics.

Counts of a text become ratios and logarithms that are nearly normal; each class has a mean and a
covariance shrunk towards the pooled one and then towards a multiple of the identity.  The score is
the logistic of the difference of the two Mahalanobis log densities, each from a cached Cholesky
factor.  Class counts, sums and outer products are summed over *all* learning rows on the executors;
a few hundred numbers reach the driver, so no sample is taken.

Defined results: a null or blank text is scored as the empty text; null ids or labels teach nothing;
without learning rows of both classes every score is 0.5 and nothing is filtered; a tie (a score on the
threshold) is predicted 1 and kept; a very long text is counted whole; repeated rows each give one row and,
if labelled, teach as often; an empty table gives no rows; extra columns are ignored by :func:`score` and
kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, learning_rows, mapped, sigmoid
from .textstats import batch_stats

MODULUS, HELD = 4, 2
THRESHOLD = 0.7
POOLED = 0.5  # share of the pooled covariance in each class's
IDENTITY = 0.1  # share of the identity
N_FEATURES = 11


def features(column: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) of transformed statistics."""
    s = {k: v.astype(np.float64) for k, v in batch_stats(column).items()}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    ratio = lambda a, b: np.sqrt(np.clip(a / b, 0, 4))
    return np.column_stack([
        np.log1p(s["n_words"]), np.log(chars / words), ratio(s["n_symbols"], chars), ratio(s["n_upper"], chars), ratio(s["n_digits"], chars),
        ratio(s["n_bangs"], words), ratio(s["n_stops"], words), ratio(s["n_repeat_words"], words), ratio(s["n_same_next"], words),
        ratio(s["n_dup_lines"], words), np.log(np.maximum(s["n_unique_words"], 1) / words),
    ])


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, identity: float = IDENTITY):
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if any(moments.get(c, (0,))[0] < 2 for c in (0, 1)):
            return
        total = sum(m[0] for m in moments.values())
        centre = sum(m[1] for m in moments.values()) / total
        self.centre = centre
        self.scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values())) / total - centre**2, 1e-8))
        means, covs = {}, {}
        for c, (n, s, ss) in moments.items():
            mean = s / n
            means[c] = (mean - centre) / self.scale
            covs[c] = (ss / n - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
        both = sum(moments[c][0] * covs[c] for c in covs) / total
        for c in (0, 1):
            cov = (1 - pooled) * covs[c] + pooled * both
            cov = (1 - identity) * cov + identity * np.trace(cov) / len(cov) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)))
            self.classes.append((means[c], np.linalg.inv(factor), float(np.log(moments[c][0] / total) - np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        bad, good = (const - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, const in self.classes)
        return sigmoid(good - bad)


def fit(rows: DataFrame) -> Discriminant:
    """From (x, __label), x being the features' bytes: per class and partition one row of count, sums and outer products."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = unpacked(batch.column("x")), np.array(batch.column("__label").to_pylist())
            x1 = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                own = x1[y == c]
                sums[c] = sums.get(c, 0) + own.T @ own
        for c, m in sums.items():
            yield pa.RecordBatch.from_pydict({"c": pa.array([c] * m.size, pa.int32()), "k": pa.array(range(m.size), pa.int32()), "v": pa.array(m.ravel())})

    found = mapped(rows, moments, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    size = N_FEATURES + 1
    out = {}
    for c in (0, 1):
        m = np.zeros(size * size)
        for r in found:
            if r["c"] == c:
                m[r["k"]] = r["v"]
        m = m.reshape(size, size)
        out[c] = (float(m[0, 0]), m[0, 1:], m[1:, 1:])
    return Discriminant(out)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the features' bytes of every row: 88 bytes that stand for the text from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tobytes() for row in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(x, pa.binary())], ["doc_id", "x"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, x binary")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float64) for x in column.to_pylist()]).reshape(-1, N_FEATURES)


def train(points: DataFrame, labels: DataFrame) -> Discriminant:
    """From :func:`described` documents and their labels; only features are joined, never texts."""
    return fit(learning_rows(points, labels, "quality", MODULUS, HELD, "x"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    points = checkpointed(described(docs))
    model = train(points, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(unpacked(batch.column("x"))))], ["doc_id", "score"])

    scored = mapped(points, run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns (without a model: all)."""
    model = train(described(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.classes:
                yield batch
                continue
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= threshold))

    return mapped(docs, run, docs.schema)
