"""Language identification with interpolated Kneser-Ney character models.

Each language has a character 4-gram model inside words (a word is framed by marks, so no context
crosses a word).  Probabilities and back-off weights of all languages stand in arrays sorted by the
64-bit hash of the n-gram; an n-gram is looked up once for all languages by binary search.  The
language with the lowest cross-entropy per character wins; the operator also flags a text as rejected
when that cross-entropy is above what ``CALIBRATION`` of the winner's own calibration texts stay under.

The models are fitted on about ``DOCS_PER_LANG`` rows per language, drawn by the hash of id and text, rows
equal in both counting once (a documented bound; nine tenths train, one tenth calibrates).  Where a language has fewer than
``FEW_ROWS`` drawn rows, those that calibrate train too, after the cutoffs were taken from models without
them.  n-grams are counted on the executors and only distinct ones reach the driver: at most the 4-grams of
letters that 400 rows a language hold, whose number levels off at some hundred thousand.  Every text is
scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without learning rows
every text is ``und``; null ids or languages teach nothing; of languages with equal cross-entropy the
first in alphabetical order wins; a very long text is scored whole; repeated rows each give one row; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, mapped, texts

MODULUS, HELD = 5, 0
UNDETERMINED = "und"
DOCS_PER_LANG = 400
FEW_ROWS = 20
#: Up to so many languages their sampling rates are broadcast, so that no text is shuffled; beyond, the
#: same join runs as a shuffle join.
MAX_BROADCAST_LANGS = 10_000
ORDER = 4
CALIBRATION = 0.995
ALPHABET = 2_000  # share of the uniform distribution at the bottom
_TEXTS_AT_ONCE = 400
_WORD = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x02", "\x03"


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower())
    return [w for w in (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found) if w]


def hashed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of character codes."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for column in codes.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language, from counts of its highest order."""

    def __init__(self, counts: dict[str, int], order: int = ORDER):
        self.prob: list[dict[str, float]] = []
        self.backoff: list[dict[str, float]] = []
        by_order = [counts]
        for _ in range(order - 1):  # lower orders count distinct left extensions
            lower: Counter[str] = Counter(g[1:] for g in by_order[0])
            by_order.insert(0, lower)
        for n, grams in enumerate(by_order, 1):
            ones, twos = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: Counter[str] = Counter()
            kinds: Counter[str] = Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            back = {h: discount * kinds[h] / total[h] for h in total}
            lower_p = (lambda g: 1.0 / ALPHABET) if n == 1 else (lambda g, p=self.prob[-1]: p[g[1:]])
            self.prob.append({g: (c - discount) / total[g[:-1]] + back[g[:-1]] * lower_p(g) for g, c in grams.items()})
            self.backoff.append(back)

    def p(self, gram: str) -> float:
        """Probability of the last character after the ones before it."""
        n = len(gram)
        if n == 0:
            return 1.0 / ALPHABET
        found = self.prob[n - 1].get(gram)
        return found if found is not None else self.backoff[n - 1].get(gram[:-1], 1.0) * self.p(gram[1:])


class Model:
    """The languages' models side by side in sorted hash arrays."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        models = [KneserNey(counts[x]) for x in self.langs]
        self.grams, self.logp, self.contexts, self.logb = [], [], [], []
        for n in range(1, ORDER + 1):
            grams = sorted(set().union(*(m.prob[n - 1] for m in models)))
            h = hashed(np.array([[ord(c) for c in g] for g in grams], np.int64).reshape(len(grams), n))
            at = np.argsort(h)
            self.grams.append(h[at])
            self.logp.append(np.log(np.array([[m.p(g) for m in models] for g in grams]).reshape(len(grams), len(models)))[at])
            contexts = sorted(set().union(*(m.backoff[n - 1] for m in models)))
            h = hashed(np.array([[ord(c) for c in g] for g in contexts], np.int64).reshape(len(contexts), n - 1))
            at = np.argsort(h)
            self.contexts.append(h[at])
            self.logb.append(np.log(np.array([[m.backoff[n - 1].get(g, 1.0) for m in models] for g in contexts]).reshape(len(contexts), len(models)))[at])
        self.cutoffs = np.full(len(self.langs), np.inf)

    def word_scores(self, unique: list[str]) -> np.ndarray:
        """Log probability of each word (with its end mark) under every language."""
        lengths = np.fromiter(map(len, unique), np.int64, len(unique)) + 1
        codes = np.frombuffer("".join(_BEGIN * (ORDER - 1) + w + _END for w in unique).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
        owner = np.repeat(np.arange(len(unique)), lengths)
        last = np.repeat(starts + ORDER - 1, lengths) + np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        score = np.zeros((len(owner), len(self.langs)))
        open_ = np.arange(len(owner))
        for n in range(ORDER, 0, -1):
            grams = codes[last[open_][:, None] + np.arange(1 - n, 1)]
            at, hit = _found(self.grams[n - 1], hashed(grams))
            score[open_[hit]] += self.logp[n - 1][at[hit]]
            open_, grams = open_[~hit], grams[~hit]
            at, hit = _found(self.contexts[n - 1], hashed(grams[:, :-1]))
            score[open_[hit]] += self.logb[n - 1][at[hit]]
        score[open_] -= np.log(ALPHABET)
        out = np.zeros((len(unique), len(self.langs)))
        np.add.at(out, owner, score)
        return out

    def entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under every language; the numbers of characters."""
        out, sizes = np.zeros((len(batch), len(self.langs))), np.zeros(len(batch), np.int64)
        for at in range(0, len(batch), _TEXTS_AT_ONCE):
            numbers: dict[str, int] = {}
            ids, owner = [], []
            for k, text in enumerate(batch[at : at + _TEXTS_AT_ONCE]):
                found = words(text)
                ids.extend(numbers.setdefault(w, len(numbers)) for w in found)
                owner.append(np.full(len(found), at + k))
                sizes[at + k] = sum(map(len, found)) + len(found)
            if numbers:
                scores, owners = self.word_scores(list(numbers)), np.concatenate(owner)
                for j in range(len(self.langs)):
                    out[:, j] += np.bincount(owners, scores[np.array(ids), j], len(batch))
        return -out / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and rejection of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
        entropy, sizes = self.entropies(batch)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(batch)), best]
        weight = np.exp((lowest[:, None] - entropy) * np.minimum(sizes, 60)[:, None])
        named = sizes > 0
        lang = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, named, strict=True)]
        return lang, np.where(named, 1.0 / weight.sum(1), 0.0), ~named | (lowest > self.cutoffs[best])


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language and key that a task meets, so that copies of a drawn row aren't shuffled."""
    seen: set = set()
    for batch in batches:
        kinds = list(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True))
        yield batch.filter(pa.array([k not in seen and not seen.add(k) for k in kinds], pa.bool_()))


def sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """(lang, text, calibrate, few) of about ``per_lang`` learning rows of each language; ``few`` marks the
    languages with fewer than FEW_ROWS of them."""
    rows = docs.where((fold(F.col("doc_id"), MODULUS) != HELD) & F.col("lang").isNotNull())
    sizes = checkpointed(rows.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"))).select("lang", "share"))
    if sizes.count() <= MAX_BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    drawn = rows.select("lang", "text", key.alias("key")).join(sizes, "lang").where(F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    drawn = mapped(drawn.select("lang", "key", "text"), _first_of_each, "lang string, key long, text string").dropDuplicates(["lang", "key"])
    drawn = checkpointed(drawn.select("lang", "text", (F.pmod("key", F.lit(10)) == 0).alias("calibrate")))
    few = checkpointed(drawn.groupBy("lang").count().select("lang", (F.col("count") < FEW_ROWS).alias("few")))
    if few.count() <= MAX_BROADCAST_LANGS:
        few = F.broadcast(few)
    return drawn.join(few, "lang")


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> Model:
    rows = sample(docs, per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                for w, n in Counter(words(text)).items():
                    framed = _BEGIN * (ORDER - 1) + w + _END
                    for i in range(len(w) + 1):
                        found[lang][framed[i : i + ORDER]] += n
        for lang, grams in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    def counts_of(part: DataFrame) -> defaultdict[str, dict[str, int]]:
        counted = mapped(part.select("lang", "text"), count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts: defaultdict[str, dict[str, int]] = defaultdict(dict)
        for r in counted.collect():
            counts[r["lang"]][r["gram"]] = r["n"]
        return counts

    counts = counts_of(rows.where("NOT calibrate"))
    model = Model(counts)
    extra = counts_of(rows.where("calibrate AND few"))
    whole = model
    if extra:
        for lang, grams in extra.items():
            counts[lang] = dict(Counter(counts[lang]) + Counter(grams))
        whole = Model(counts)
    if not model.langs:
        return whole

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: j for j, x in enumerate(model.langs)}
        for batch in batches:
            entropy, sizes = model.entropies(texts(batch.column("text")))
            js = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()])
            ok = (sizes >= 20) & (js >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(js[ok], pa.int32()), pa.array(entropy[ok, js[ok]])], ["j", "e"])

    cut = mapped(rows.where("calibrate").select("lang", "text"), own_entropy, "j int, e double").groupBy("j").agg(F.percentile("e", F.lit(CALIBRATION)).alias("e")).collect()
    for r in cut:
        whole.cutoffs[whole.langs.index(model.langs[r["j"]])] = r["e"]
    return whole


def identify(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = train(docs, per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    out = mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(fold(F.col("doc_id"), MODULUS) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
