"""Numpy kernels over a slice of texts: tokens, 64-bit token hashes, hashed n-grams.

A slice is (offsets, bytes) with ``offsets[i]:offsets[i+1]`` the UTF-8 bytes of row i.
All functions are vectorised over the whole slice; none looks at single rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_CLASS = np.full(256, 1, np.uint8)  # 0 white space, 1 word byte, 2 ASCII punctuation
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _CLASS[_b] = 2
WORDS = np.where(_CLASS == 0, 0, 1).astype(np.uint8)
LETTERS = np.where(_CLASS == 1, 1, 0).astype(np.uint8)
LETTERS[48:58] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``size`` of them."""
    return _powers(1 << max(20, int(size).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of each ``[start, end)``: equal for equal bytes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def tokens(offsets: np.ndarray, data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero byte class, never across rows: (start, end, row)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = classes[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets[(offsets > 0) & (offsets < n)]] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def gram_windows(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every byte window of ``size`` inside the ranges, and the range it is from."""
    count = np.maximum(end - start - size + 1, 0)
    owner = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return start[owner] + np.arange(len(owner)) - first[owner], owner


def framed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges' bytes, lower-cased and each framed by marks (bytes 1 and 2): (bytes, starts, ends)."""
    size = end - start + 2
    to = np.cumsum(size)
    at = to - size
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    out[at], out[to - 1] = 1, 2
    owner = np.repeat(np.arange(len(start)), size - 2)
    inner = np.arange(len(owner)) - (np.cumsum(size - 2) - (size - 2))[owner]
    out[at[owner] + 1 + inner] = LOWER[data[start[owner] + inner]]
    return out, at, to


def sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` rows."""
    return np.bincount(rows, values, n)
