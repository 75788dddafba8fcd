"""Toxicity by non-negative positive-unlabelled learning.

The confirmed toxic documents are the positives; all other text, labelled or not, is unlabelled.  A
logistic model over the rates of words and word stems minimises the class-prior-corrected risk
``pi E_p[l(+)] + max(0, E_u[l(-)] - pi E_p[l(-)])``; when the bracket turns negative, the step is taken
against it (the non-negative correction).  The prior is the toxic share of the labelled learning rows.

Features and model are fitted on at most ``MAX_POSITIVE`` positive and ``MAX_UNLABELLED`` unlabelled
rows, chosen by the hash of id and text (rows equal in both count once).  The unlabelled rows are drawn
from all learning rows, positives among them, as the risk's ``E_u`` is over the whole population.
These bounds are the only sample; the prior and the scores cover all rows.

Defined results: a null text is scored as the empty text; null ids or labels teach nothing; without a
positive learning row every score is the prior (0 without labels); a tie (a score on the threshold) is
predicted 1 and dropped, stems of equal gain are taken in alphabetical order; a very long text is scored
whole; repeated rows each give one row; an empty table gives no rows; extra columns are ignored by
:func:`score` and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, mapped, sigmoid, texts

MODULUS, HELD = 5, 0
THRESHOLD = 0.5
MAX_POSITIVE = 5_000
MAX_UNLABELLED = 20_000
N_FEATURES = 300
MIN_DOCUMENTS = 4
L2 = 2e-3
STEPS = 400
RATE = 0.05
STEMS = range(3, 8)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000
_STEMS_AT_ONCE = 200_000


def stems(word: str) -> list[str]:
    """The word and its proper prefixes of 3 to 7 letters, marked as such."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def word_counts(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def rates(counts: Counter[str], columns: dict[str, int], lookup: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Feature vector of one text: bounded logarithm of each stem's rate among its words.

    ``lookup`` remembers the features of each word that was met.
    """
    x = np.zeros(len(columns))
    total = 0
    for word, n in counts.items():
        total += n
        if (found := lookup.get(word)) is None:
            found = tuple(columns[s] for s in stems(word) if s in columns)
            if len(lookup) < _CACHE:
                lookup[word] = found
        for j in found:
            x[j] += n
    return np.minimum(3.0, np.log1p(300.0 * x / (total + 100.0)))


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, n): in how many texts a stem occurs.

    Counts are summed over texts before they are shuffled, up to ``_STEMS_AT_ONCE`` stems at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["stem", "n"])

        for batch in batches:
            for text in texts(batch.column("text")):
                found.update({s for w in set(_WORD.findall(text.lower())) for s in stems(w)})
                if len(found) >= _STEMS_AT_ONCE:
                    yield taken()
                    found.clear()
        yield taken()

    return mapped(rows.select("text"), run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def select_features(rows: DataFrame, n_features: int = N_FEATURES) -> list[str]:
    """Stems whose share of documents differs most between positives (``p``) and the other rows.

    All stems of MIN_DOCUMENTS positives are compared; only the chosen ones come to the driver.
    """
    sizes = {r["p"]: r["count"] for r in rows.groupBy("p").count().collect()}
    n_p, n_u = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
    positive = stem_counts(rows.where("p")).where(F.col("n") >= MIN_DOCUMENTS).withColumnRenamed("n", "np")
    other = stem_counts(rows.where("NOT p")).withColumnRenamed("n", "nu")
    nu = F.coalesce("nu", F.lit(0))
    gain = (F.col("np") / n_p - nu / n_u) / F.sqrt(F.col("np") + nu + 1)
    best = positive.join(other, "stem", "left").select("stem", gain.alias("gain")).orderBy(F.desc("gain"), "stem").limit(n_features)
    return [r["stem"] for r in best.collect()]


class Model:
    """Logistic model over stem rates."""

    def __init__(self, columns: list[str], weights: np.ndarray, bias: float):
        self.columns, self.weights, self.bias = {s: j for j, s in enumerate(columns)}, weights, bias

    def score(self, column: pa.Array, lookup: dict) -> np.ndarray:
        if not self.columns:
            return np.full(len(column), float(sigmoid(np.float64(self.bias))))
        x = np.array([rates(word_counts(t), self.columns, lookup) for t in texts(column)]).reshape(-1, len(self.columns))
        return sigmoid(x @ self.weights + self.bias)


def non_negative_pu(xp: np.ndarray, xu: np.ndarray, prior: float, l2: float = L2, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative PU risk with logistic loss, by Adam."""
    theta, m, v = np.zeros(xp.shape[1] + 1), 0.0, 0.0
    theta[-1] = -2.0
    for step in range(1, steps + 1):
        zp, zu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
        negative_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative_part >= 0:
            gp, gu = -prior / len(zp) * np.ones(len(zp)), sigmoid(zu) / len(zu)
        else:
            gp, gu = prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
        gradient = np.append(xp.T @ gp + xu.T @ gu + l2 * theta[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, float]:
    """(p, text) of the drawn positives and unlabelled rows (None without positives); the class prior.

    Toxic ids are drawn by their hash at a rate that keeps the list near its bound, rows by the hash of
    id and text; of both kinds the lowest hashes up to the bound stay.  Only those keys (a bounded
    table, broadcast) meet the documents, and one row of each key goes on.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), MODULUS) != HELD))
    toxic, labelled = usable.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    if not toxic:
        return None, 0.0
    ticket = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000))
    ids = usable.where((F.col("toxic") == 1) & (ticket < int(1e6 * min(1.0, 0.9 * MAX_POSITIVE / toxic)))).select("doc_id").distinct()
    ids = checkpointed(ids.orderBy(F.xxhash64("doc_id")).limit(MAX_POSITIVE))
    learning = docs.where(fold(F.col("doc_id"), MODULUS) != HELD).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__key"))
    rate = int(1e6 * min(1.0, 0.9 * MAX_UNLABELLED / max(1, docs.count())))
    pools = ((True, learning.join(F.broadcast(ids), "doc_id", "left_semi"), MAX_POSITIVE), (False, learning.where(F.pmod("__key", F.lit(1_000_000)) < rate), MAX_UNLABELLED))
    drawn = [rows.select("__key").distinct().orderBy(F.xxhash64("__key")).limit(most).withColumn("p", F.lit(p)) for p, rows, most in pools]
    chosen = checkpointed(drawn[0].unionByName(drawn[1]))
    rows = mapped(learning.join(F.broadcast(chosen), "__key").select("__key", "p", "text"), _first_of_each, "__key long, p boolean, text string")
    return checkpointed(rows.dropDuplicates(["__key", "p"]).select("p", "text")), toxic / labelled


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key and kind that a task meets, so that copies of a drawn row aren't shuffled."""
    seen: set = set()
    for batch in batches:
        kinds = list(zip(batch.column("__key").to_pylist(), batch.column("p").to_pylist(), strict=True))
        first = [k not in seen and not seen.add(k) for k in kinds]
        yield batch.filter(pa.array(first, pa.bool_()))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows, prior = sample(docs, labels)
    columns = [] if rows is None else select_features(rows)
    if not columns or prior >= 1:
        return Model([], np.zeros(0), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    index = {s: j for j, s in enumerate(columns)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            x = [rates(word_counts(t), index, lookup).astype(np.float32).tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(x, pa.binary())], ["p", "x"])

    got = mapped(rows, vectors, "p boolean, x binary").toArrow()  # bounded by the sample's two limits
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(columns))
    p = got.column("p").to_numpy(zero_copy_only=False).astype(bool)
    if p.all():
        return Model([], np.zeros(0), math.log(prior / (1 - prior)))
    return Model(columns, *non_negative_pu(x[p], x[~p], prior))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.score(batch.column("text"), lookup))], ["doc_id", "score"])

    scored = mapped(docs.select("doc_id", "text"), run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column("text"), lookup) < threshold))

    return mapped(docs, run, docs.schema)
