"""Vectorised text primitives shared by the corpus operators.

Everything works on the UTF-8 bytes of an Arrow string column, half a megabyte of whole
documents at a time, so that a task's memory is bounded by the longest single text and not by
the number of rows. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; no byte of a
multi-byte UTF-8 character falls in that set, so byte runs and character runs are the same words.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SHINGLE_WORDS = 5

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_JOIN = _U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word; works in place on a uint64 array."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values for a seed."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


_TABLE = stream64(17, 256)
_TABLE_LOWER = _TABLE[LOWER]
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if _powers.size < n:
        n = max(n, CHUNK_BYTES + 1)
        p = np.full(n, _BASE)
        p[0] = 1
        q = np.full(n, _U(pow(int(_BASE), -1, 1 << 64)))
        q[0] = 1
        _powers, _inverse = np.cumprod(p), np.cumprod(q)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary column, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    buf, offs = string_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 65536)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of consecutive rows: byte spans, and each row's range of words."""

    buf: np.ndarray
    row_offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of every word, A-Z lower-cased if asked."""
        n = self.buf.size
        _grow(n + 1)
        v = (_TABLE_LOWER if lower else _TABLE)[self.buf]
        v *= _powers[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * _inverse[self.starts])


def words(buf: np.ndarray, row_offs: np.ndarray, breaks: np.ndarray = SPACE) -> Words:
    """Words of consecutive rows: runs of bytes that ``breaks`` does not mark."""
    n = buf.size
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(buf, row_offs, e, e, np.zeros(len(row_offs), np.int64))
    space = breaks[buf]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:] = space
    first = row_offs[:-1]
    edge[first[first < n]] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    edge[:n] = space
    edge[row_offs[1:]] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return Words(buf, row_offs, starts, ends, np.searchsorted(starts, row_offs))


def shingles(hashes: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word windows in order, and row offsets.

    A row of one to k-1 words has its whole sequence as its only window; a row without words none.
    """
    n, have = hashes.size, np.diff(offs)
    counts = np.where(have >= k, have - k + 1, (have > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(out_offs[-1], np.uint64)
    if n >= k:
        h = np.full(n - k + 1, _U(k))
        for i in range(k):
            h *= _JOIN
            h += hashes[i : n - k + 1 + i]
        last = np.repeat(offs[1:], have)[: n - k + 1]
        h = h[np.arange(k, n + 1) <= last]
        long = np.repeat(have >= k, counts)
        out[long] = h
    for length in range(1, k):
        rows = np.flatnonzero(have == length)
        if rows.size:
            h = np.full(rows.size, _U(length))
            for i in range(length):
                h *= _JOIN
                h += hashes[offs[rows] + i]
            out[out_offs[rows]] = h
    return mix64(out), out_offs


def distinct_sorted(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and row offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:])]
    sizes = np.fromiter((p.size for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for a row without any."""
    total = np.zeros(values.size + 1, np.int64 if values.dtype.kind in "biu" and values.dtype != np.uint64 else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def row_minima(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minimum of each row's values; the type's largest value for a row without any."""
    out = np.full(len(offs) - 1, np.iinfo(values.dtype).max, values.dtype)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if some.size:
        out[some] = np.minimum.reduceat(values, offs[:-1][some])
    return out


def binary_column(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Rows of a numpy array as an Arrow binary column."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
