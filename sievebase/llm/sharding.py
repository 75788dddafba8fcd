"""K-d tree sharding by distributed weighted medians.

Rows are points in the space of their metadata.  A node that should become k leaves is split along its
widest dimension where floor(k/2)/k of its bytes lie below (the weighted median for even k), until every
node is one leaf, that is about the target bytes.  Law: ``bytes`` - the leaves' sizes are near equal.

The upper levels are split by all executors at once.  The weighted quantile is exact to a fraction of a
leaf: one aggregation per round sums the bytes of all splitting nodes in equal intervals of their key, and
the interval with the quantile is cut again until it holds little enough.  A round returns at most
max(``CELLS``, 16 a node) sums to the driver, and there are nodes only until each has few enough rows
(``ROWS_PER_SUBTREE``) for one task, which then cuts the subtree below it by exact weighted medians; so
what the driver holds grows with rows / ROWS_PER_SUBTREE, and not with leaves.

Keys carry a hash of the row number below the dimension's value, so one hot value (or thousands of equal
rows) is still split where the bytes say.  Defined results: a null text has 16 bytes and checksum 0; null
and NaN metadata sort as 0 or as the hash of null, infinite ones as the largest finite value; ties (values
equal to a 2**31st of the dimension's extent) are split by the row's hash; a very long text is one row,
and a leaf is as large as it has to be; repeated rows are rows of their own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, mapped

BUCKETS = 2048
#: Sums that a round brings to the driver, as long as a node gets LEAST_BUCKETS.
CELLS = 1 << 18
LEAST_BUCKETS = 16
#: A subtree of at most so many rows is cut by one task, once the tree has MIN_TIPS tips to share among tasks.
ROWS_PER_SUBTREE = 500_000
MIN_TIPS = 16
#: A quantile may miss its target by this share of a leaf's bytes.
TOLERANCE = 0.001
ROWS_PER_SLOT_RUN = 200_000
OVERHEAD = 16
_VALUE_BITS, _HASH_BITS = 31, 32
_POINT = "doc_id long, weight long, text_crc32 long, row long, shard long"


class Tree:
    """Nodes by number: how many leaves below and the first of them; of inner ones the cut and the children."""

    def __init__(self, leaves: int):
        self.leaves, self.first = [leaves], [0]
        self.dim, self.cut, self.low, self.high = [0], [0], [-1], [-1]

    def split(self, node: int, dim: int, cut: int) -> None:
        left = self.leaves[node] // 2
        self.dim[node], self.cut[node], self.low[node], self.high[node] = dim, cut, len(self.leaves), len(self.leaves) + 1
        self.leaves += [left, self.leaves[node] - left]
        self.first += [self.first[node], self.first[node] + left]
        for column, value in ((self.dim, 0), (self.cut, 0), (self.low, -1), (self.high, -1)):
            column += [value, value]

    def tips(self) -> list[int]:
        return [n for n, low in enumerate(self.low) if low < 0]

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The tip that each column of ``keys`` falls into."""
        dim, cut, low, high = (np.array(x, np.int64) for x in (self.dim, self.cut, self.low, self.high))
        at = np.zeros(keys.shape[1], np.int64)
        open_ = np.flatnonzero(low[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = np.where(keys[dim[node], open_] < cut[node], low[node], high[node])
            open_ = open_[low[at[open_]] >= 0]
        return at


def coordinates(rows: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a double: numbers and times as they are (null and NaN 0), anything else by its hash."""
    out = []
    for d in dims:
        kind = rows.schema[d].dataType
        numeric = isinstance(kind, (T.NumericType, T.TimestampType, T.DateType, T.BooleanType))
        value = F.col(d).cast("timestamp") if isinstance(kind, T.DateType) else F.col(d)
        out.append(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)) if numeric else F.pmod(F.xxhash64(d), F.lit(1 << 31)).cast("double"))
    return out


@dataclass
class Keys:
    """Integer keys of the dimensions: the value scaled to 31 bits, then 32 bits of the row's hash."""

    bounds: list[tuple[float, float]]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        row = batch.column("row").to_numpy().astype(np.uint64)
        out = np.empty((len(self.bounds), len(row)), np.int64)
        for d, (lo, hi) in enumerate(self.bounds):
            x = np.clip(batch.column(f"x{d}").to_numpy(zero_copy_only=False), lo, hi)
            scaled = np.floor((x / 2 - lo / 2) / ((hi / 2 - lo / 2) or 1.0) * ((1 << _VALUE_BITS) - 1)).astype(np.int64)
            out[d] = (scaled << _HASH_BITS) + (mixed(row, d) >> np.uint64(32)).astype(np.int64)
        return out


def mixed(row: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers) that spreads row numbers evenly."""
    z = (row + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def grow(points: DataFrame, n_dims: int, leaves: int, tolerance: float = TOLERANCE) -> tuple[Tree, Keys]:
    """The upper tree over ``points`` (x0.., weight, row), and the keys it cuts.

    Its tips are single leaves, empty, or small enough for one task.
    """
    names = [f"x{d}" for d in range(n_dims)]
    finite = {n: F.when(F.abs(n) < float("inf"), F.col(n)) for n in names}
    bounds = points.agg(*[f(finite[n]).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = Keys([(bounds[f"lo{n}"] or 0.0, bounds[f"hi{n}"] or 0.0) for n in names])
    tree = Tree(leaves)
    while True:
        tips = tree.tips()
        found = extents(points, keys, tree, [n for n in tips if tree.leaves[n] > 1])
        if len(tips) >= MIN_TIPS:
            found = {n: e for n, e in found.items() if e.rows > ROWS_PER_SUBTREE}
        if not found:
            return tree, keys
        for node, (dim, cut) in quantiles(points, keys, tree, found, tolerance).items():
            tree.split(node, dim, cut)


@dataclass
class Extent:
    low: np.ndarray  # by dimension
    high: np.ndarray
    bytes: int
    rows: int


def extents(points: DataFrame, keys: Keys, tree: Tree, nodes: list[int]) -> dict[int, Extent]:
    """Ranges of the keys, bytes and rows of each of ``nodes`` that has rows."""
    n_dims, number = len(keys.bounds), np.full(len(tree.low), -1)
    number[nodes] = np.arange(len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n_dims, len(nodes)), np.iinfo(np.int64).max), np.full((n_dims, len(nodes)), -1)
        sums, rows = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for batch in batches:
            k, w = keys.of(batch), batch.column("weight").to_numpy()
            j = number[tree.place(k)]
            k, w, j = k[:, j >= 0], w[j >= 0], j[j >= 0]
            for d in range(n_dims):
                np.minimum.at(low[d], j, k[d])
                np.maximum.at(high[d], j, k[d])
            np.add.at(sums, j, w)
            np.add.at(rows, j, 1)
        own = np.flatnonzero(rows)
        for d in range(n_dims):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), d)), *(pa.array(x[own]) for x in (low[d], high[d], sums, rows))], ["j", "d", "lo", "hi", "w", "n"])

    if not nodes:
        return {}
    found = mapped(points, run, "j long, d long, lo long, hi long, w long, n long").groupBy("j", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("w").alias("w"), F.sum("n").alias("n")).orderBy("j", "d").toArrow()
    j, lo, hi, w, n = (found.column(c).to_numpy().reshape(-1, n_dims) for c in ("j", "lo", "hi", "w", "n"))
    return {nodes[j[i, 0]]: Extent(lo[i], hi[i], int(w[i, 0]), int(n[i, 0])) for i in range(len(j))}


def quantiles(points: DataFrame, keys: Keys, tree: Tree, found: dict[int, Extent], tolerance: float) -> dict[int, tuple[int, int]]:
    """(dimension, cut) of each node of ``found``: its widest dimension, the key that half its leaves' share lies below."""
    out: dict[int, tuple[int, int]] = {}
    dim = {n: int(np.argmax(e.high - e.low)) for n, e in found.items()}
    low = {n: int(e.low[dim[n]]) for n, e in found.items()}
    high = {n: int(e.high[dim[n]]) + 1 for n, e in found.items()}
    target = {n: e.bytes * (tree.leaves[n] // 2) / tree.leaves[n] for n, e in found.items()}
    slack = {n: e.bytes / tree.leaves[n] * tolerance for n, e in found.items()}
    while open_ := [n for n in found if n not in out]:
        buckets = max(LEAST_BUCKETS, min(BUCKETS, CELLS // len(open_)))
        width = {n: max(1, -(-(high[n] - low[n]) // buckets)) for n in open_}
        sums = histogram(points, keys, tree, open_, buckets, *(np.array([x[n] for n in open_]) for x in (dim, low, high, width)))
        for j, n in enumerate(open_):
            so_far = np.cumsum(sums[j])
            b = min(int(np.searchsorted(so_far, target[n])), int(np.flatnonzero(sums[j])[-1]))
            before = so_far[b] - sums[j, b]
            if sums[j, b] <= slack[n] or width[n] == 1:
                out[n] = dim[n], low[n] + width[n] * (b + (1 if so_far[b] - target[n] <= target[n] - before else 0))
            else:
                target[n] -= before
                low[n], high[n] = low[n] + width[n] * b, low[n] + width[n] * (b + 1)
    return out


def histogram(points: DataFrame, keys: Keys, tree: Tree, nodes: list[int], buckets: int, dim: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(nodes, buckets): the bytes in each interval of each node's key."""
    number = np.full(len(tree.low), -1)
    number[nodes] = np.arange(len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(nodes) * buckets, np.int64)
        for batch in batches:
            k, w = keys.of(batch), batch.column("weight").to_numpy()
            j = number[tree.place(k)]
            own = np.flatnonzero(j >= 0)
            j, w = j[own], w[own]
            k = k[dim[j], own]
            inside = (k >= low[j]) & (k < high[j])
            j, k, w = j[inside], k[inside], w[inside]
            np.add.at(sums, j * buckets + (k - low[j]) // width[j], w)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], ["cell", "w"])

    found = mapped(points, run, "cell long, w long").groupBy("cell").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(len(nodes) * buckets, np.int64)
    out[found.column("cell").to_numpy()] = found.column("w").to_numpy()
    return out.reshape(len(nodes), buckets)


def cut_up(keys: np.ndarray, weight: np.ndarray, row: np.ndarray, leaves: int, first: int) -> np.ndarray:
    """The leaf of each row of one subtree, by exact weighted medians."""
    out = np.empty(len(weight), np.int64)
    open_ = [(np.arange(len(weight)), leaves, first)]
    while open_:
        own, leaves, first = open_.pop()
        if leaves == 1 or not len(own):
            out[own] = first
            continue
        k = keys[:, own]
        order = np.lexsort((row[own], k[int(np.argmax(k.max(1) - k.min(1)))]))
        so_far = np.cumsum(weight[own[order]])
        left = leaves // 2
        target = so_far[-1] * left / leaves
        b = int(np.searchsorted(so_far, target))
        b += so_far[b] - target <= target - (so_far[b - 1] if b else 0)
        open_ += [(own[order[:b]], left, first), (own[order[b:]], leaves - left, first + left)]
    return out


def shard(docs: DataFrame, dims: list[str], leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Give the number of ``leaves``, or ``target_bytes`` of a leaf.  The texts are read once; all that
    follows works on a checkpoint of a few numbers per row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + OVERHEAD).alias("weight"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *(c.alias(f"x{d}") for d, c in enumerate(coordinates(docs, dims))),
    )
    points = checkpointed(base.withColumn("row", F.monotonically_increasing_id()))
    rows, total = points.agg(F.count("*"), F.sum("weight")).first()
    if leaves is None:
        leaves = max(1, -(-(total or 0) // (target_bytes or 1)))
    tree, keys = grow(points, len(dims), leaves)
    runs = max(1, -(-rows // (leaves * ROWS_PER_SLOT_RUN)))

    first, below = np.array(tree.first, np.int64), np.array(tree.leaves, np.int64)
    dims_ = [f"x{d}" for d in range(len(dims))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tip = tree.place(keys.of(batch))
            yield batch.append_column("tip", pa.array(tip)).append_column("shard", pa.array(np.where(below[tip] == 1, first[tip], -1)))

    def leaf(table: pa.Table) -> pa.Table:
        batch, tip = table.combine_chunks().to_batches()[0], table.column("tip")[0].as_py()
        shard = cut_up(keys.of(batch), batch.column("weight").to_numpy(), batch.column("row").to_numpy(), int(below[tip]), int(first[tip]))
        return pa.Table.from_arrays([*(batch.column(c) for c in ("doc_id", "weight", "text_crc32", "row")), pa.array(shard)], ["doc_id", "weight", "text_crc32", "row", "shard"])

    tipped = mapped(points, place, f"doc_id long, weight long, text_crc32 long, {', '.join(f'{x} double' for x in dims_)}, row long, tip long, shard long")
    done = tipped.where("shard >= 0").select("doc_id", "weight", "text_crc32", "row", "shard")
    cut = tipped.where("shard < 0").drop("shard").groupBy("tip").applyInArrow(leaf, _POINT)
    run = F.pmod(F.xxhash64("row", F.lit(len(dims))), F.lit(runs))
    placed = checkpointed(done.unionByName(cut).withColumn("run", run))
    # slots: number the rows of each (shard, run), a run being of bounded length, and add what lies before
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "run").orderBy("row")
    numbered = placed.withColumn("slot", F.row_number().over(own).cast("long") - 1).join(starts, ["shard", "run"])
    return numbered.select(
        "doc_id", F.col("weight").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
