"""Variable-capacity best-fit packing into training sequences.

Several sequence lengths are permitted.  Pieces are taken from long to short; each goes to the open bin
it fits most tightly.  If none has room, a bin is opened whose capacity has the lowest price per token
it can be expected to hold - the piece plus whatever still-unpacked pieces fit into the rest - so
the lengths are chosen jointly with the contents.  In the end every bin is cut down to the smallest
permitted length that holds it.

The price of a sequence is its length, a quadratic part for attention and a fixed overhead; tokens are
counted by ``length`` (words and an end mark by default; any integer column will do).  Texts longer
than the largest length are cut into pieces, so every token is packed exactly once.

Rows are dealt by the hash of a row number into groups of about ``ROWS_PER_GROUP``, each packed by one
task with numpy; a group's waste is a few open bins.  Defined results: a null or empty text is one piece
of one token (the end mark); repeated rows are packed as often as they occur; an empty table gives no
bins; ties (pieces of one length, bins with equally much room, lengths of equal price) go by the row's number, the
bin opened last and the shorter length; a null doc_id is packed under null; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

LENGTHS = (512, 1024, 2048, 4096, 8192)
ROWS_PER_GROUP = 50_000
FIXED_PRICE = 64
QUADRATIC = 1 / 65_536
_SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin long, capacity int, position int, offset int"


def words_and_end(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def price(capacity: int) -> float:
    return capacity + QUADRATIC * capacity**2 + FIXED_PRICE


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes are from 1 to the largest length."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ascending = sorted(sizes)
    tokens = [0, *accumulate(ascending)]
    room: dict[int, list[int]] = {}  # free tokens -> open bins
    free: list[int] = []  # the keys of room, sorted
    filled: list[int] = []
    capacity: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for rank, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(free, size)
        if at < len(free):
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop(at)
        else:
            waiting = len(sizes) - rank - 1  # the shorter pieces, first in ascending order

            def per_token(c: int) -> float:
                fits = min(waiting, bisect_right(ascending, c - size))
                return price(c) / (size + min(c - size, tokens[fits]))

            c = min((c for c in lengths if c >= size), key=per_token)
            b, left = len(filled), c
            filled.append(0)
            capacity.append(c)
        out[i] = (b, filled[b])
        filled[b] += size
        left -= size
        if left:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append(b)
    return out


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, length: Column | None = None, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start and n_tokens within the document; bin, the bin's
    capacity, and the piece's position and offset in it."""
    lengths = tuple(sorted(lengths))
    # checkpointed: a row's number must not change when a lost executor's work is done again
    sized = checkpointed(docs.select("doc_id", (words_and_end(F.col("text")) if length is None else length).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    groups = max(1, -(-sized.count() // rows_per_group))
    dealt = sized.select("doc_id", "n", "row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        most = lengths[-1]
        n = np.maximum(table.column("n").to_numpy(), 1)
        pieces = -(-n // most)
        owner = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[owner] - piece * most, most)
        placed = np.array(best_fit(size.tolist(), lengths), np.int64).reshape(-1, 2)
        contents = np.bincount(placed[:, 0], size).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        capacity = np.array(lengths)[np.searchsorted(lengths, contents)] if len(size) else contents
        rank = np.lexsort((placed[:, 1], placed[:, 0]))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(placed[rank, 0]) > 0])) if len(size) else np.zeros(0, np.int64)
        position = np.empty(len(size), np.int64)
        position[rank] = np.arange(len(size)) - np.repeat(starts, np.diff(np.append(starts, len(size))))
        group = table.column("group")[0].as_py() if len(n) else 0
        return pa.table({
            "doc_id": table.column("doc_id").cast(pa.int64()).take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * most, pa.int64()), "n_tokens": pa.array(size, pa.int64()),
            "bin": pa.array((group << 32) + placed[:, 0], pa.int64()), "capacity": pa.array(capacity[placed[:, 0]], pa.int32()), "position": pa.array(position, pa.int32()), "offset": pa.array(placed[:, 1], pa.int32()),
        })

    return dealt.groupBy("group").applyInArrow(run, _SCHEMA)
