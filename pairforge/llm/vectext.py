"""Vectorised text primitives on Arrow string buffers: word spans, word hashes, k-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_pow = np.ones(1, np.uint64)

#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words split at the ASCII white space 0x20, 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, small letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        grown = np.full(max(n, 2 * len(_pow), 4096), _BASE)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _pow = np.multiply.accumulate(grown)
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about limit bytes; longer rows stand alone. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1, lo + 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Spans(NamedTuple):
    """Spans of all rows of a slice; those of row i are first[i] to first[i + 1]."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of disjoint ascending non-empty spans of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
    values = _BYTE[data[inside + np.repeat(starts, lens)]] * _powers(int(lens.max()))[inside]
    return mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Spans:
    """Maximal runs of bytes with table[byte], none across two rows."""
    n = len(data)
    inside = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Spans(first, start, end, hashed(data, start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive hashes, at each place that has k."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] + np.uint64(k)
    for i in range(1, k):
        out = out * _STEP + h[i : i + m]
    return mix(out)


def gram_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """grams(h, k) at the places given only."""
    out = h[at] + np.uint64(k)
    for i in range(1, k):
        out = out * _STEP + h[at + i]
    return mix(out)


def whole(first: np.ndarray, row: np.ndarray, k: int, m: int) -> np.ndarray:
    """Whether the k-gram at each of m places lies within one row."""
    at = np.arange(m)
    return at + k <= first[row[:m] + 1]


class Known:
    """Numbers 0, 1, ... of hashes in order of their arrival, in 16 bytes each."""

    def __init__(self):
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for a new one."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.number[at], -1)

    def add(self, h: np.ndarray) -> np.ndarray:
        """Numbers of new hashes, which ascend."""
        made = np.arange(len(self.keys), len(self.keys) + len(h))
        at = np.searchsorted(self.keys, h)
        self.keys, self.number = np.insert(self.keys, at, h), np.insert(self.number, at, made)
        return made
