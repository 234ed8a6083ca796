"""Words, lines and shingles of Arrow text columns as NumPy arrays.

Texts are read as UTF-8 bytes straight from the Arrow buffers.  Words are
maximal runs of bytes outside 0x20 and 0x09-0x0D, which are the same runs of
characters, since bytes of multi-byte characters are above 0x7F.  A token gets a
64-bit hash: a polynomial over random byte values, mixed at the end.  Every
function works through a column in slices, so its memory follows the slice and
the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE + 4096), _U(base))
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are disjoint and ascending."""
    out = np.empty(len(starts), np.uint64)
    table = _LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE, "right")))
        b = ends[j - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[raw[a:b]] * _power(_BASE, b - a)[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        h = (sums[e] - sums[s]) * _power(_BASE_INV, b - a + 1)[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64))
        i = j
    return out


def row_slices(offsets: np.ndarray, size: int = 2 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


class Spans:
    """Tokens of consecutive rows: row, hash, first byte and end of each."""

    __slots__ = ("ends", "hashes", "rows", "starts")

    def __init__(self, rows, hashes, starts, ends):
        self.rows, self.hashes, self.starts, self.ends = rows, hashes, starts, ends


def words(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False, hashed: bool = True) -> Spans:
    """The words of rows ``i`` to ``j``; rows count from ``i``, bytes from the column's start."""
    a, b = offsets[i], offsets[j]
    gap = SPACE[raw[a:b]]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1 if b > a else np.zeros(0, np.int64)
    # A row's first byte starts a word even where the row before ends in one.
    inner = offsets[i + 1 : j] - a
    inner = np.unique(inner[(inner > 0) & (inner < b - a)])
    cut = inner[~gap[inner] & ~gap[inner - 1]] if len(inner) else inner
    starts = edge[~gap[edge]]
    ends = edge[gap[edge]]
    if b > a and not gap[0]:
        starts = np.concatenate(([0], starts))
    if b > a and not gap[-1]:
        ends = np.concatenate((ends, [b - a]))
    if len(cut):
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    starts, ends = starts + a, ends + a
    rows = np.searchsorted(offsets[i : j + 1], starts, "right") - 1
    return Spans(rows, hash_spans(raw, starts, ends, lower) if hashed else None, starts, ends)


def lines(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Spans:
    """The lines between ``\\n`` of rows ``i`` to ``j``, empty ones included; an empty row has one."""
    a, b = offsets[i], offsets[j]
    breaks = np.flatnonzero(raw[a:b] == 10) + a
    starts = np.sort(np.concatenate((offsets[i:j], breaks + 1)))
    # The end of a line: the next break, or the end of its row.
    ends = np.sort(np.concatenate((breaks, offsets[i + 1 : j + 1])))
    row_of = np.concatenate((np.arange(j - i), np.searchsorted(offsets[i : j + 1], breaks, "right") - 1))
    rows = np.sort(row_of)
    return Spans(rows, hash_spans(raw, starts, ends), starts, ends)


def shingles(w: Spans, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of ``size`` words; a row with fewer words has its whole sequence."""
    h, rows = w.hashes, w.rows
    counts = np.bincount(rows, minlength=n_rows)
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = mix(out + h[k : len(h) - size + 1 + k] + _U(k + 1)) if len(out) else out
    keep = rows[: len(out)] == rows[size - 1 :] if len(out) else np.zeros(0, bool)
    r, s = rows[: len(out)][keep], out[keep]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        acc = np.full(len(short), _U(0xA5A5A5A5))
        for k in range(size - 1):
            has = counts[short] > k
            at = np.minimum(first + k, len(h) - 1)
            acc = np.where(has, mix(acc + h[at] + _U(101 + k)), acc)
        r, s = np.concatenate((r, short)), np.concatenate((s, acc))
    return r, s
