"""Language-model scoring by deleted interpolation.

``P(w | u v)`` mixes the maximum-likelihood estimates of trigram, bigram and unigram with the uniform
distribution.  The weights depend on how often the context was seen (buckets by powers of two, of the
pair ``u v`` where it was seen and of the word ``v`` elsewhere) and are learned by
expectation-maximisation on held-out counts: one fold of the learning documents is deleted from the
counts, its tokens are predicted from the rest, and EM fits the weights to them; then all learning
documents are counted.  Counts cover every learning document; n-grams are told apart by 64-bit hashes,
unverified, so that two of a corpus of N distinct ones share a count with probability N**2 / 2**65.

The corpus is encoded once: a task turns its texts into chunks of about ``CHUNK_TOKENS`` tokens (word
numbers and word hashes), written to the checkpoint folder.  A chunk sends each of its distinct n-grams
once, in packets by range of hash; a range's task adds up the counts of all askers and answers each in its
own order.  So a very frequent word or passage is one entry per chunk, and no table of n-grams is ever
broadcast or collected.  Words and bigrams go first.  The answers also say which of them occur in another
chunk, and only trigrams whose two bigrams both do go in the second round: the others can't occur
elsewhere, so their own count is the corpus count.

A range hears from at most about ``FAN`` askers.  With more chunks the exchange has levels: groups of
``FAN`` chunks merge their packets for a coarse range, ask for the merged n-grams in finer ranges, and hand
the answers on.  The number of packets thus grows with n log n of the corpus and not with its square.

To the driver come only sizes and the held-out counts by bucket and estimates rounded to half powers of
two: at most BUCKETS x 64 ** 3 cells however large the corpus, some thousands in practice.

Defined results: a null text is the empty text (its only token is the end); a null doc_id is scored but
teaches nothing; repeated rows each give one row and count as often as they occur; equal texts get
equal scores; a very long text is one document of its chunk, counted and scored whole; an empty table
gives no rows; with no learning rows every token has probability 1, so both scores are 0; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, mapped
from .textstats import as_binary

MODULUS, HELD, DELETED = 7, 2, 5
CHUNK_TOKENS = 1_500_000
GRAMS_PER_TASK = 1_500_000
#: Askers whose packets meet in one task.
FAN = 4_096
#: Powers of two an int64 count can reach, and unseen; first by the word before, then by the pair before.
POWERS = 64
BUCKETS = 2 * POWERS
EM_ROUNDS = 60
FLOOR = 1e-4
#: Roles of chunks: counted, deleted for EM, held out; a chunk's number modulo 4 is its role.
FIT, EM, OUT = 0, 1, 2
#: Numbers and hashes of the two marks; words are numbered from 2.
BEGIN, END = 0, 1
_MARKS = (0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F)
_ENCODED = "chunk long, n_tokens long, ids binary, lengths binary, tokens binary, hashes binary"
_PACKET = "range int, asker long, grams binary, fit binary, em binary, many binary"
_ANSWER = "asker long, range int, fit binary, em binary, shared binary, known long"
_ANSWER_ARROW = pa.schema([("asker", pa.int64()), ("range", pa.int32()), *((c, pa.binary()) for c in ("fit", "em", "shared")), ("known", pa.int64())])
_PACKET_ARROW = pa.schema([("range", pa.int32()), ("asker", pa.int64()), *((c, pa.binary()) for c in ("grams", "fit", "em", "many"))])


def packed(x: np.ndarray) -> bytes:
    """Compressed byte plane by byte plane: the high planes of small numbers are runs of zeros."""
    import zstandard

    return zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def unpacked(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def mixed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (v + np.uint64(0x632BE59BD9B4E019) + (u >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# --- chunks ----------------------------------------------------------------------------------------


class Chunk:
    """Documents of one role, their words numbered in order of appearance."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        numbers = self.numbers
        own = [numbers.setdefault(w, len(numbers) + 2) for w in text.translate(LOWER_BYTES).split()]
        own.append(END)
        self.tokens.append(np.array(own, np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(own))
        self.size += len(own)

    def row(self, number: int) -> dict:
        from xxhash import xxh64_intdigest

        hashes = np.array([*_MARKS, *(xxh64_intdigest(w) for w in self.numbers)], np.uint64)
        ids = np.array([v for x in self.ids for v in (x is not None, x or 0)], np.int64)
        return {"chunk": number, "n_tokens": self.size, "ids": packed(ids), "lengths": packed(np.array(self.lengths, np.int64)), "tokens": packed(np.concatenate(self.tokens)), "hashes": hashes.tobytes()}


def encode(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per chunk; a chunk's number is made of its task's, its order there and its role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.binary()) for c in ("ids", "lengths", "tokens", "hashes"))])
        open_: dict[int, Chunk] = {}
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for doc_id, text in zip(ids, as_binary(batch.column("text")), strict=True):
                part = HELD if doc_id is None else zlib.crc32(str(doc_id).encode()) % MODULUS
                role = OUT if part == HELD else EM if part == DELETED else FIT
                chunk = open_.setdefault(role, Chunk())
                chunk.add(doc_id, text.as_py())
                if chunk.size >= chunk_tokens:
                    yield pa.RecordBatch.from_pylist([open_.pop(role).row((task << 24) + 4 * made + role)], schema)
                    made += 1
        for role, chunk in open_.items():
            yield pa.RecordBatch.from_pylist([chunk.row((task << 24) + 4 * made + role)], schema)
            made += 1

    return mapped(docs.select("doc_id", "text"), run, _ENCODED)


class Asked:
    """Distinct n-grams in order of their hashes, cut into ranges of hashes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order]
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)

    def packets(self, chunk: int, ranges: int) -> Iterator[pa.RecordBatch]:
        ends, role = cuts(self.grams, 0, ranges, ranges), chunk % 4
        for r in np.flatnonzero(np.diff(ends)):
            counts = packed(self.counts[ends[r] : ends[r + 1]].astype(np.int64))
            yield pa.RecordBatch.from_pylist([{"range": int(r), "asker": chunk, "grams": planes(self.grams[ends[r] : ends[r + 1]]), "fit": counts if role == FIT else b"", "em": counts if role == EM else b"", "many": b""}], _PACKET_ARROW)

    def totals(self, answers: list[dict], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus counts in both folds and whether another chunk has it, of each n-gram in its first order."""
        return tuple(x[self.place] for x in assembled(answers, cuts(self.grams, 0, ranges, ranges), 0))


class Grams:
    """A chunk's tokens and their n-grams; bit 0 of a hash tells bigrams (1) from words (0)."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.tokens = unpacked(row["tokens"], np.uint32).view(np.int32)  # a chunk has fewer words than 2 ** 31
        self.lengths = unpacked(row["lengths"], np.int64)
        hashes = np.frombuffer(row["hashes"], np.uint64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.before = np.roll(self.tokens, 1)
        self.before[self.first] = BEGIN
        pairs, pair_of, pair_counts = np.unique(self.before.astype(np.int64) * len(hashes) + self.tokens, return_inverse=True, return_counts=True)
        self.pair_of = pair_of.astype(np.int32)
        self.pairs = mixed(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]) | np.uint64(1)
        words = np.bincount(self.tokens, minlength=len(hashes))
        words[BEGIN] = len(self.lengths)  # as a context: once a document
        self.n_words = len(hashes)
        self.one_two = Asked(np.concatenate([hashes & ~np.uint64(1), self.pairs]), np.concatenate([words, pair_counts]).astype(np.int32))
        del pairs, pair_of, pair_counts
        # trigrams, of all tokens but a document's first
        self.inner = np.ones(len(self.tokens), bool)
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        triples, triple_of, self.triple_counts = np.unique(self.pair_of[at - 1].astype(np.int64) * len(hashes) + self.tokens[at], return_inverse=True, return_counts=True)
        self.triple_of = triple_of.astype(np.int32)
        self.left, last = (triples // len(hashes)).astype(np.int32), triples % len(hashes)
        self.right = np.empty(len(triples), np.int32)
        self.right[self.triple_of] = self.pair_of[at]
        self.triples = mixed(self.pairs[self.left], hashes[last])

    def three(self, shared: np.ndarray) -> tuple[np.ndarray, Asked]:
        """Which trigrams may occur in another chunk, and these."""
        elsewhere = shared[self.left] & shared[self.right]
        return elsewhere, Asked(self.triples[elsewhere], self.triple_counts[elsewhere])

    def first_round(self, answers: list[dict], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.one_two.totals([a for a in answers if a["round"] == 1], ranges)

    def seen(self, answers: list[dict], ranges: tuple[int, int], em: bool) -> tuple[np.ndarray, ...]:
        """For each token, the corpus counts (of the fit fold, with ``em`` of both) of the word before it and of
        the pair before it, and of its word, bigram and trigram."""
        fit, more, shared = self.first_round(answers, ranges[0])
        counts = fit + more if em else fit
        words, pairs = counts[: self.n_words], counts[self.n_words :]
        elsewhere, asked = self.three(shared[self.n_words :])
        own = self.triple_counts.astype(np.int64) if self.chunk % 4 == FIT or em and self.chunk % 4 == EM else np.zeros(len(self.triple_counts), np.int64)
        fit, more, _ = asked.totals([a for a in answers if a["round"] == 2], ranges[1])
        own[elsewhere] = fit + more if em else fit
        two = pairs[self.pair_of]
        context, three = np.empty_like(two), two.copy()  # a document's first token: its context is the document's begin
        context[1:] = two[:-1]
        context[self.first] = words[BEGIN]
        three[self.inner] = own[self.triple_of]
        return words[self.before], context, words[self.tokens], two, three


# --- the exchange of counts ------------------------------------------------------------------------


def planes(grams: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane: the high planes are zeros."""
    return np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def cuts(grams: np.ndarray, first: int, n: int, ranges: int) -> np.ndarray:
    """Ends of ``n`` of the ``ranges`` equal ranges of hashes, from the one numbered ``first``, in sorted ``grams``."""
    lowest = np.array([(k << 64) // ranges for k in range(first, first + n)], np.uint64)
    return np.append(np.searchsorted(grams, lowest), len(grams))


def assembled(answers: list[dict], ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the answers of consecutive ranges say, one after the other."""
    n = int(ends[-1])
    fit, em, shared = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for a in answers:
        k = a["range"] - first
        own = slice(ends[k], ends[k + 1])
        fit[own], em[own] = unpacked(a["fit"], np.int64), unpacked(a["em"], np.int64)
        shared[own] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=own.stop - own.start)
    return fit, em, shared


class Merged:
    """The distinct n-grams of several packets of one range, their counts added up."""

    def __init__(self, rows: list[dict]):
        grams = [from_planes(r["grams"]) for r in rows]
        self.grams, place = np.unique(np.concatenate(grams), return_inverse=True)
        self.places = np.split(place, np.cumsum([len(g) for g in grams])[:-1])
        self.fit, self.em = np.zeros(len(self.grams), np.int64), np.zeros(len(self.grams), np.int64)
        askers = np.bincount(place, minlength=len(self.grams))
        for r, at in zip(rows, self.places, strict=True):
            for total, part in ((self.fit, r["fit"]), (self.em, r["em"])):
                if part:
                    total[at] += unpacked(part, np.int64)
            if r["many"]:
                askers[at] += np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(at))
        self.many = askers > 1


def reply(rows: list[dict], places: list[np.ndarray], totals: tuple[np.ndarray, np.ndarray, np.ndarray], known: int | None) -> pa.Table:
    """One answer for each packet, and with ``known`` one row of asker -1 that tells it."""
    fit, em, shared = totals
    out = [{"asker": r["asker"], "range": r["range"], "fit": packed(fit[at]), "em": packed(em[at]), "shared": np.packbits(shared[at]).tobytes()} for r, at in zip(rows, places, strict=True)]
    return pa.Table.from_pylist(out + ([] if known is None else [{"asker": -1, "known": known}]), _ANSWER_ARROW)


def looked_up(packets: DataFrame, ranges: int, finer: int, askers: int, fan: int = FAN) -> DataFrame:
    """(asker, range, fit, em, shared, known): corpus counts of each packet's n-grams, in its order; for each
    last range a row of asker -1 with the number of its distinct learned words.

    Packets come cut into ``ranges`` ranges; while more than ``fan`` askers are left, groups of them are
    merged and ask on in ``finer`` ranges within each.
    """
    if askers <= fan:

        def answer(table: pa.Table) -> pa.Table:
            m = Merged(rows := table.to_pylist())
            begin = np.uint64(_MARKS[BEGIN]) & ~np.uint64(1)
            known = (m.fit + m.em > 0) & (m.grams & np.uint64(1) == 0) & (m.grams != begin)
            return reply(rows, m.places, (m.fit, m.em, m.many), int(known.sum()))

        return packets.groupBy("range").applyInArrow(answer, _ANSWER)
    groups = -(-askers // fan)
    # read twice: to be merged, and to be answered
    packets = checkpointed(packets.withColumn("node", F.col("range") * F.lit(groups).cast("long") + F.pmod(F.xxhash64("asker"), F.lit(groups))))

    def merge(table: pa.Table) -> pa.Table:
        m, node = Merged(rows := table.to_pylist()), table.column("node")[0].as_py()
        first = rows[0]["range"] * finer
        ends, out = cuts(m.grams, first, finer, ranges * finer), []
        for k in np.flatnonzero(np.diff(ends)):
            own = slice(ends[k], ends[k + 1])
            out.append({"range": int(first + k), "asker": node, "grams": planes(m.grams[own]), "fit": packed(m.fit[own]), "em": packed(m.em[own]), "many": np.packbits(m.many[own]).tobytes()})
        return pa.Table.from_pylist(out, _PACKET_ARROW)

    def hand_on(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:  # asker -1
            return found.select(_ANSWER_ARROW.names)
        m, first = Merged(rows := table.to_pylist()), table.column("range")[0].as_py() * finer
        return reply(rows, m.places, assembled(found.to_pylist(), cuts(m.grams, first, finer, ranges * finer), first), None)

    found = looked_up(packets.groupBy("node").applyInArrow(merge, _PACKET), ranges * finer, finer, groups, fan)
    return packets.groupBy("node").cogroup(found.groupBy("asker")).applyInArrow(hand_on, _ANSWER)


def layout(grams: int, chunks: int, fan: int) -> tuple[int, int]:
    """How many ranges chunks cut their n-grams into, and how many finer ones each level makes of one."""
    last = max(1, -(-grams // GRAMS_PER_TASK))
    levels, left = 0, chunks
    while left > fan:
        levels, left = levels + 1, -(-left // fan)
    finer = max(1, round(last ** (1 / (levels + 1))))
    return max(1, -(-last // finer**levels)), finer


# --- mixture ---------------------------------------------------------------------------------------


def bucket(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """By the pair before, one for every power of two; where it is unseen, by the word before (0: unseen too)."""
    power = lambda x: 1 + np.log2(np.maximum(x, 1)).astype(np.int64)
    return np.where(pair > 0, POWERS - 1 + np.minimum(POWERS, power(pair)), np.where(word > 0, np.minimum(POWERS - 1, power(word)), 0))


def estimates(counts: tuple[np.ndarray, ...], n: int) -> Iterator[np.ndarray]:
    """Trigram, bigram and unigram estimate of each token."""
    before, context, one, two, three = counts
    yield three / np.maximum(context, 1)
    yield two / np.maximum(before, 1)
    yield one / max(n, 1)


def probabilities(weights: np.ndarray, counts: tuple[np.ndarray, ...], n: int, v: int) -> np.ndarray:
    own = bucket(counts[0], counts[1])
    p = weights[own, 3] / (v + 1)
    for k, f in enumerate(estimates(counts, n)):
        p += weights[own, k] * f
    return p


def allowed(b: int) -> np.ndarray:
    """Which of the four estimates have a seen context in a bucket."""
    return np.array([b >= POWERS, b > 0, True, True], float)


def learned_weights(cells: list, v: int) -> np.ndarray:
    """(BUCKETS, 4) by EM; ``cells`` holds (b, n, f3, f2, f1): bucket, tokens, sums of the three estimates.

    A bucket without held-out tokens takes the weights of the next lower one of its kind that has some.
    """
    out = np.array([allowed(b) * [0.4, 0.3, 0.25, 0.05] for b in range(BUCKETS)])
    for b in range(BUCKETS):
        own = np.array([[c["n"], c["f3"] / c["n"], c["f2"] / c["n"], c["f1"] / c["n"], 1.0 / (v + 1)] for c in cells if c["b"] == b], float).reshape(-1, 5)
        n, f = own[:, 0], own[:, 1:]
        weights = out[b] / out[b].sum()
        if len(n):
            for _ in range(EM_ROUNDS):
                share = f * weights
                share /= share.sum(1, keepdims=True)
                weights = (n[:, None] * share).sum(0) / n.sum()
        elif b - 1 not in (-1, 0, POWERS - 1):
            weights = out[b - 1]
        out[b] = weights
    out = np.maximum(out, [0.0, 0.0, FLOOR, FLOOR])
    return out / out.sum(1, keepdims=True)


def held_out_cells(g: Grams, answers: list[dict], ranges: tuple[int, int], n: int) -> list[dict]:
    """The tokens of one deleted chunk by bucket and rounded estimates, as predicted from the fit fold."""
    counts = g.seen(answers, ranges, em=False)
    cell = bucket(counts[0], counts[1])
    for f in estimates(counts, n):
        cell = cell * 64 + np.where(f > 0, np.clip(np.round(-2 * np.log2(np.maximum(f, 1e-30))), 0, 62), 63).astype(np.int64)
    cells, place = np.unique(cell, return_inverse=True)
    sums = [np.bincount(place, w) for w in (None, *estimates(counts, n))]
    return [{"cell": int(c), "n": int(k), "f3": float(x), "f2": float(y), "f1": float(z)} for c, k, x, y, z in zip(cells, *sums, strict=True)]


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    encoded = checkpointed(encode(docs, chunk_tokens))
    role = F.pmod("chunk", F.lit(4))
    sizes = {r["role"]: r for r in encoded.groupBy(role.alias("role")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("chunks")).collect()}
    tokens, chunks = sum(r["n"] for r in sizes.values()), sum(r["chunks"] for r in sizes.values())
    n_fit = sizes[FIT]["n"] if FIT in sizes else 0
    n = n_fit + (sizes[EM]["n"] if EM in sizes else 0)
    (ranges1, finer1), (ranges2, finer2) = layout(2 * tokens, chunks, fan), layout(tokens, chunks, fan)
    ranges = (ranges1, ranges2)

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from Grams(row).one_two.packets(row["chunk"], ranges1)

    def ask_second(chunk: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            g = Grams(row)
            shared = g.first_round(found.to_pylist(), ranges1)[2]
            out += g.three(shared[g.n_words :])[1].packets(row["chunk"], ranges2)
        return pa.Table.from_batches(out, _PACKET_ARROW)

    def with_answers(chunks: DataFrame, found: DataFrame):
        return chunks.groupBy("chunk").cogroup(found.groupBy("asker"))

    first = checkpointed(looked_up(mapped(encoded, ask_first, _PACKET), ranges1, finer1, chunks, fan))
    v = first.where("asker = -1").agg(F.sum("known")).first()[0] or 0
    first = first.where("asker >= 0").withColumn("round", F.lit(1))
    second = checkpointed(looked_up(with_answers(encoded, first).applyInArrow(ask_second, _PACKET), ranges2, finer2, chunks, fan))
    found = first.unionByName(second.where("asker >= 0").withColumn("round", F.lit(2))).drop("known")

    def predicted(chunk: pa.Table, own: pa.Table) -> pa.Table:
        cells = [c for row in chunk.to_pylist() for c in held_out_cells(Grams(row), own.to_pylist(), ranges, n_fit)]
        return pa.Table.from_pylist(cells, pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("f3", pa.float64()), ("f2", pa.float64()), ("f1", pa.float64())]))

    deleted = with_answers(encoded.where(role == EM), found.where(F.pmod("asker", F.lit(4)) == EM))
    cells = deleted.applyInArrow(predicted, "cell long, n long, f3 double, f2 double, f1 double")
    cells = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "f3", "f2", "f1"))).orderBy("cell").collect()
    weights = learned_weights([{"b": c["cell"] >> 18, **{k: c[k] for k in ("n", "f3", "f2", "f1")}} for c in cells], v)
    if not n:
        weights = np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS, 1))

    def scores(chunk: pa.Table, own: pa.Table) -> pa.Table:
        out = {"doc_id": [], "role": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for row in chunk.to_pylist():
            g = Grams(row)
            counts = g.seen(own.to_pylist(), ranges, em=True)
            one = counts[2]
            p = probabilities(weights, counts, n, v)
            ids = unpacked(row["ids"], np.int64).reshape(-1, 2)
            out["doc_id"] += [int(x) if known else None for known, x in ids]
            out["role"] += [row["chunk"] % 4] * len(ids)
            for name, values in (("n_tokens", np.ones(len(p), np.int64)), ("n_known", (one > 0).astype(np.int64)), ("base_score", np.log10((one + 1) / (n + v + 1))), ("score", np.log10(p))):
                out[name] += np.add.reduceat(values, g.first).tolist()
        kinds = {"doc_id": pa.int64(), "role": pa.int32(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(x, kinds[k]) for k, x in out.items()})

    scored = with_answers(encoded, found).applyInArrow(scores, "doc_id long, role int, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (F.col("doc_id").isNotNull() & (F.col("role") == OUT)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
