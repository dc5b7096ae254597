"""Vectorised text primitives over Arrow string buffers.

All functions work on the raw UTF-8 bytes of a batch, so a whole batch of
documents is tokenised and hashed with a handful of numpy passes and no
per-word Python objects.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# the workers' memory is bounded: freed buffers and arrays of a megabyte or more go back to the system at once
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # the size from which an allocation is a mapping of its own

#: Bytes of text that are worked on at once, so that the arrays of a step stay in the cache.
CHUNK = 1 << 18

_U = np.uint64
#: Odd multiplier of the rolling polynomial (golden ratio in 64 bits).
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS = {b: np.ones(1, dtype=np.uint64) for b in (_BASE, _INVERSE)}

#: Bytes that separate words: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """``base`` to the powers 0 to n, grown on demand."""
    if len(_POWERS[base]) <= n:
        grown = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        _POWERS[base] = np.multiply.accumulate(grown)
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's, published)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the n + 1 offsets into them."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each document's first word (n + 1 bounds)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~spaces[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[full] = inside[full]
    last = full[1:] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, _INVERSE)[starts])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's ``size``-word windows, and their bounds.

    A document with fewer words has its whole word sequence as one; without
    words it has none.  Repeats within a document are kept.
    """
    counts = np.diff(bounds)
    n = len(words)
    h = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size if len(h) else 0):
        h = h * _BASE + words[k : n - size + 1 + k]
    h = mix(h)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(many, out=out[1:])
    at = np.repeat(bounds[:-1] - out[:-1], many) + np.arange(out[-1])
    short = np.flatnonzero((counts > 0) & (counts < size))
    at[out[:-1][short]] = 0
    got = h[at] if len(h) else np.zeros(out[-1], dtype=np.uint64)
    for d in short:
        x = np.array([counts[d]], dtype=np.uint64)
        for w in words[bounds[d] : bounds[d + 1]]:
            x = mix(x * _BASE + w)
        got[out[d]] = x[0]
    return got, out
