"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two texts are linked when at most 3 bits differ.  Half of that radius,
rounded down, is 1: every distinct fingerprint emits all variants within one bit of itself, and two
fingerprints at distance 2 meet in a variant between them.  The odd third bit is taken care of by
masking: the bits form four blocks of 16, and for each block a variant set is emitted that leaves this
block out.  If i is the first block in which two linked fingerprints differ, block i holds at least one of
the differing bits, blocks before it none and those after it at most two, so with block i masked the
two meet by flipping bits after block i only.  That makes 49 + 33 + 17 + 1 = 100 variants each, and
no linked pair is missed.

Variants are shuffled by their value.  Fingerprints that share a variant are compared in full; from
every bucket only a spanning forest of its verified links goes on (a bucket of k fingerprints gives
fewer than k edges, never all pairs), which keeps every connected component whole.  Copies share a
fingerprint and count as one vertex, however many there are.

Defined results: a null or word-less text has fingerprint 0 and is linked like any other; fewer than
three words make one shingle; a tie (a bit set in exactly half the hashes) is 0; a very long text is hashed
whole, in runs of shingles; repeated rows each give one row; a null doc_id never names a component (a
component of null ids only has a null component_id); an empty table gives no rows; extra columns are
ignored by :func:`group` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER_BYTES, checkpointed, fresh, mapped
from .components import components
from .textstats import as_binary

DISTANCE = 3
SHINGLE = 3
SEED = 42
BLOCK = 16
VARIANTS = 100
#: Variants that one task holds at once (about 16 bytes each, three times while sorting).
VARIANTS_PER_TASK = 1_500_000
_CHUNK = 100_000


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 hashes of a text's shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in as_binary(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in as_binary(batch.column("text"))], np.uint64).view(np.int64)
            yield batch.append_column(name, pa.array(found, pa.int64()))

    return mapped(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all variants and the fingerprint behind each.

    A key holds the masked block's number above the 48 bits that are left.
    """
    keys, own = [], []
    for i in range(4):
        low = np.uint64(BLOCK * i)
        kept = ((fps >> np.uint64(BLOCK * (i + 1)) if i < 3 else fps * np.uint64(0)) << low) | (fps & ((np.uint64(1) << low) - np.uint64(1)))
        flips = np.array([0, *(1 << p for p in range(BLOCK * i, 48))], np.uint64)
        keys.append(((kept[:, None] ^ flips[None, :]) | np.uint64(i << 48)).ravel())
        own.append(np.repeat(fps, len(flips)))
    return np.concatenate(keys), np.concatenate(own)


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) that connect whatever is linked inside each bucket of equal keys."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.repeat(starts, sizes)
    far = np.bitwise_count(fps ^ fps[first]) > DISTANCE
    near = ~far & (np.arange(len(fps)) != first)
    a, b = [fps[first[near]]], [fps[near]]
    for s in np.unique(first[far]):  # buckets whose members aren't all linked to the first
        rest = fps[s : s + sizes[np.searchsorted(starts, s)]]
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                linked = np.bitwise_count(rest ^ front[0]) <= DISTANCE
                a.append(np.repeat(front[:1], int(linked.sum())))
                b.append(rest[linked])
                front, rest = np.concatenate([front[1:], rest[linked]]), rest[~linked]
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 5_000):
                keys, own = variants(fps[at : at + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column("key").to_numpy().view(np.uint64))
            fps.append(batch.column("fp").to_numpy().view(np.uint64))
        if not keys:
            return
        a, b = bucket_links(np.concatenate(keys), np.concatenate(fps))
        pairs = np.unique(np.stack([a, b], 1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * VARIANTS // VARIANTS_PER_TASK))
    emitted = mapped(distinct, emit, "key long, fp long").repartition(tasks, "key")
    return mapped(emitted, meet, "a long, b long").distinct()


def placed(fps: DataFrame) -> DataFrame:
    """(fp, least, label) of every distinct fingerprint: its smallest doc_id and its component's label."""
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct.select("fp"))).withColumnRenamed("v", "fp")
    return distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    fps = checkpointed(fingerprints(docs))
    vertices = placed(fps)
    # a checkpoint between aggregate and join: only a join that reads plain exchanges can split a hot label
    smallest = checkpointed(vertices.groupBy("label").agg(F.min("least").alias("component_id")))
    classes = vertices.join(smallest, "label").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: one with the smallest doc_id (without an id only where no row
    of the group has one) and, among those, the smallest fingerprint.

    A fingerprint belongs to one group only, so it tells apart rows that share an id or have none; the
    rows' fingerprints are computed a second time instead of storing the texts.
    """
    fps = checkpointed(fingerprints(docs))
    first = placed(fps).groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first"))
    kept = checkpointed(first.select(F.col("first.least").alias("least"), F.col("first.fp").alias("fp")))
    repeated = fps.join(kept, fps["doc_id"].eqNullSafe(kept["least"]) & (fps["fp"] == kept["fp"]), "left_semi").groupBy("doc_id", "fp").count().where("count > 1")
    fp, own_id, own_fp = (fresh(name, docs.columns) for name in ("fp", "kept_id", "kept_fp"))
    rows = with_fingerprint(docs, fp)
    out = rows.join(kept.toDF(own_id, own_fp), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(fp) == F.col(own_fp)), "left_semi")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", fp])
    return out.select(*docs.columns)
