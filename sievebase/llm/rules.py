"""Quality rules with risk-controlled cutoffs.

Each rule measures a statistic.  In every stratum (a range of lengths) the statistics are put on one scale,
each divided by its median among the stratum's documents without a good label, and a document is
rejected when its largest scaled statistic lies above the stratum's cutoff.  Cutoffs come from good
documents: the fixed ladder of cutoffs is walked from lenient to strict, and a step is taken while the
exact binomial test still shows that the share of good documents it would reject is below ``RISK``.  The
scales don't look at those documents, and walking in a fixed order needs no correction, so only over
the strata is the error ``DELTA`` divided (Bonferroni): with probability 1 - DELTA over the draw of labels
no stratum loses more than ``RISK`` of its good documents that pass the base rule.

A stratum of fewer than :func:`least_labels` good documents can't be certified; it is merged with the
smaller of its neighbours until each has enough or one is left.  That looks at numbers of labels only, so
the guarantee holds for the merged strata.  With fewer than 149 good labels in all nothing is rejected.

Defined results: a null or blank text has no words and fails the base rule; labels with a null id or
null value teach nothing, repeated labels of a document count once; a tie (a scaled statistic on the
cutoff) is kept; a very long text is counted whole, in the last stratum; repeated document rows each give
one row; without labels only the base rule acts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped
from .textstats import batch_stats

RISK = 0.02
DELTA = 0.05
MIN_WORDS = 50
#: Lower ends of the strata, in words.
STRATA = (0, 150, 400, 1000)
#: The ladder: cutoffs fall from 1 to 2 ** -12 by eighths of an octave.
STEPS = 96
LADDER = [2.0 ** (-k / 8) for k in range(STEPS + 1)]
#: Least scale of a statistic, so that none exceeds 1 / LEAST_SCALE when divided by its scale.
LEAST_SCALE = 2.0**-9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_same_next")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules are made of, one row per document row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(stats[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    return mapped(docs.select("doc_id", "text"), count, _SCHEMA)


def rules() -> dict[str, Column]:
    """Statistics from 0 (good) to 1, one per rule."""

    def share(part: Column, whole: str) -> Column:
        return F.least(F.lit(1.0), part / F.greatest(F.col(whole), F.lit(1)))

    return {
        "symbols": share(F.col("n_symbols"), "word_chars"),
        "capitals": share(F.col("n_upper"), "word_chars"),
        "bangs": share(F.col("n_bangs"), "n_words"),
        "repeats": share(F.col("n_repeat_words"), "n_words"),
        "stutter": share(F.col("n_same_next"), "n_words"),
        "dup_lines": share(F.col("n_dup_lines") * 10, "n_words"),
        "long_words": share(F.col("word_chars") / 30, "n_words"),
    }


def stratum(strata: tuple[int, ...] = STRATA) -> Column:
    out = F.lit(0)
    for k, least in enumerate(strata):
        out = F.when(F.col("n_words") >= least, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly (up to rounding)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=np.float64)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified_cutoffs(histogram: dict[tuple[int, int], int], strata: int, risk: float = RISK, delta: float = DELTA) -> dict[int, float]:
    """stratum -> cutoff.  ``histogram`` counts good documents by stratum and the number of ladder steps whose
    cutoff their statistic lies above."""
    out = {}
    for s in range(strata):
        counts = np.array([histogram.get((s, b), 0) for b in range(STEPS + 2)])
        n = int(counts.sum())
        above = np.cumsum(counts[::-1])[::-1]  # above[b]: rejected by at least b of the steps
        for k in range(STEPS + 1):
            rejected = int(above[STEPS + 1 - k])
            if not n or rejected > n * risk or binomial_cdf(rejected, n, risk) > delta / strata:
                break
            out[s] = LADDER[k]
    return out


def least_labels(risk: float = RISK, delta: float = DELTA, strata: int = len(STRATA)) -> int:
    """Good documents a stratum needs: with fewer, not even a cutoff that none of them exceeds is certified."""
    return math.ceil(math.log(delta / strata) / math.log1p(-risk))


def merged_strata(labels: list[int], risk: float = RISK, delta: float = DELTA, strata: tuple[int, ...] = STRATA) -> tuple[int, ...]:
    """Lower ends of the strata after those with too few of the good ``labels`` were merged."""
    ends, sizes = list(strata), list(labels)
    while len(ends) > 1 and min(sizes) < least_labels(risk, delta, len(ends)):
        k = sizes.index(min(sizes))
        left = k if k and (k + 1 == len(sizes) or sizes[k - 1] <= sizes[k + 1]) else k + 1  # joins the one before it
        sizes[left - 1 : left + 1] = [sizes[left - 1] + sizes[left]]
        del ends[left]
    return tuple(ends)


def steps_above(x: Column) -> Column:
    """Number of ladder steps whose cutoff ``x`` (at most 1) lies above."""
    return F.when(x <= LADDER[-1], 0).otherwise(F.least(F.lit(STEPS), F.lit(STEPS) + F.ceil(F.log2(x) * 8))).cast("int")


def scaled(scales: dict[tuple[int, str], float], strata: tuple[int, ...]) -> Column:
    """The largest scaled statistic, times LEAST_SCALE (at most 1)."""
    s, out = stratum(strata), F.lit(0.0)
    for k in range(len(strata)):
        out = F.when(s == k, F.greatest(*(x * (LEAST_SCALE / scales.get((k, r), 1.0)) for r, x in rules().items()))).otherwise(out)
    return out


def median_scales(histogram: dict[tuple[int, str, int], int]) -> dict[tuple[int, str], float]:
    """(stratum, rule) -> upper end of the ladder step that holds the median, at least LEAST_SCALE."""
    out = {}
    for s, name in {k[:2] for k in histogram}:
        counts = np.cumsum([histogram.get((s, name, b), 0) for b in range(STEPS + 1)])
        out[s, name] = max(LEAST_SCALE, LADDER[STEPS - int(np.searchsorted(counts, counts[-1] / 2))])
    return out


@dataclass(frozen=True)
class Cutoffs:
    strata: tuple[int, ...]  # lower ends, in words
    scales: dict[tuple[int, str], float]  # (stratum, rule)
    cutoffs: dict[int, float]  # of the strata that reject at all

    def rejected(self) -> Column:
        """True where the largest scaled statistic lies above its stratum's cutoff (as counted on the labels)."""
        s, above, out = stratum(self.strata), steps_above(scaled(self.scales, self.strata)), F.lit(False)
        for k, cutoff in self.cutoffs.items():
            out = out | ((s == k) & (above >= STEPS + 1 - LADDER.index(cutoff)))
        return out


def fit_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """Scales from all documents without a good label, cutoffs from all good documents (quality 1); of both,
    those that pass the base rule.

    Only histograms of strata x rules x steps come to the driver, whatever the number of documents.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    passed, statistics = counts.where(~base_failed()), rules()
    taught = passed.join(good, "doc_id", "left_semi")
    sizes = {x["s"]: x["count"] for x in taught.groupBy(stratum().alias("s")).count().collect()}
    strata = merged_strata([sizes.get(k, 0) for k in range(len(STRATA))], risk, delta)
    s = stratum(strata).alias("s")
    rows = passed.join(good, "doc_id", "left_anti").select(s, F.explode(F.array(*(F.struct(F.lit(r).alias("r"), c.alias("x")) for r, c in statistics.items()))).alias("e"))
    found = rows.groupBy("s", F.col("e.r").alias("r"), steps_above(F.col("e.x")).alias("b")).count().collect()
    scales = median_scales({(x["s"], x["r"], x["b"]): x["count"] for x in found})
    found = taught.groupBy(s, steps_above(scaled(scales, strata)).alias("b")).count().collect()
    return Cutoffs(strata, scales, certified_cutoffs({(x["s"], x["b"]): x["count"] for x in found}, len(strata), risk, delta))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every document row."""
    counts = checkpointed(document_counts(docs))
    rejected, failed = fit_cutoffs(counts, labels, risk, delta).rejected(), base_failed()
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"),
    )
