"""Document statistics, computed batch by batch from the Arrow buffers.

Byte-level counts run over the whole batch in numpy; only words and lines are looked at text by text.
Every text is read whole.  A null text counts as empty: all its statistics are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_CLASS[65:91] = 2  # A-Z
_CLASS[48:58] = 3  # 0-9
_CLASS[np.frombuffer(b"!", np.uint8)] = 4
_CLASS[np.frombuffer(b".,;:?", np.uint8)] = 5
_CLASS[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 6
_CLASS[0x80:0xC0] = 7  # continuation bytes
BYTE_STATS = {"n_symbols": 1, "n_upper": 2, "n_digits": 3, "n_bangs": 4, "n_stops": 5, "n_blanks": 6, "n_continued": 7}
WORD_STATS = ("n_words", "n_unique_words", "n_same_next", "n_dup_lines", "n_repeat_words", "n_lines")
STATS = ("n_bytes", *BYTE_STATS, "word_chars", *WORD_STATS)


def as_binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def batch_stats(column: pa.ChunkedArray | pa.Array) -> dict[str, np.ndarray]:
    """Every statistic of :data:`STATS` as one int64 array per name, a value per text."""
    data = as_binary(column)
    n = len(data)
    offsets = np.frombuffer(data.buffers()[1], np.int64, n + 1, data.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    out = {"n_bytes": np.diff(offsets)}
    kinds = _CLASS[raw[offsets[0] : offsets[-1]]] if n else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    for name, code in BYTE_STATS.items():
        out[name] = np.diff(np.searchsorted(np.flatnonzero(kinds == code), edges))
    out["word_chars"] = out["n_bytes"] - out["n_continued"] - out["n_blanks"]
    rows = np.array([word_stats(x.as_py()) for x in data], dtype=np.int64).reshape(n, len(WORD_STATS))
    return out | dict(zip(WORD_STATS, rows.T, strict=True))


def word_stats(text: bytes) -> tuple[int, ...]:
    """The values of :data:`WORD_STATS`; ``bytes.split`` separates at the six ASCII blanks."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, text.count(b"\n") + 1 if text else 0)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    lines = text.split(b"\n")
    dup_lines = 0
    if len(lines) > 1:
        with_word = [x for x in lines if x and not x.isspace()]
        dup_lines = len(with_word) - len(set(with_word))
    return n, len(numbers), int(np.count_nonzero(ids[1:] == ids[:-1])), dup_lines, repeat_words(ids, len(numbers)), len(lines)


def repeat_words(ids: np.ndarray, n_unique: int) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    n = len(ids)
    if n < 4 or n_unique == n:
        return 0
    pairs = ids[:-1] * n_unique + ids[1:]
    if n_unique > 2_000_000:  # the cube would not fit in 64 bits: number the pairs anew
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n_unique + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n + 2, bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    hit[starts] = hit[starts + 1] = hit[starts + 2] = True
    return int(np.count_nonzero(hit))
