"""Hashed character n-grams of each text's distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from glosspark.llm.hashing import LETTERS, LOWER, U, framed, gram_windows, mix, prefix_hash, range_hash, tokens


def distinct_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's distinct words (start, end), and the (row, word) pairs without repeats."""
    low = LOWER[data]
    start, end, row = tokens(offsets, low, LETTERS)
    h = mix(range_hash(prefix_hash(low), start, end))
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    pair = np.unique(row * max(len(first), 1) + word)
    return start[first], end[first], pair // max(len(first), 1), pair % max(len(first), 1)


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the given words, and its word."""
    text, a, b = framed(data, start, end)
    prefix = prefix_hash(text)
    buckets, words = [], []
    for n in orders:
        at, owner = gram_windows(a, b, n)
        buckets.append((mix(range_hash(prefix, at, at + n) + U(n)) >> U(64 - bits)).astype(np.int64))
        words.append(owner)
    return np.concatenate(buckets), np.concatenate(words)


def count_features(offsets: np.ndarray, data: np.ndarray, orders: tuple[int, ...], bits: int) -> dict:
    """Each row's distinct buckets and their counts over its distinct words, packed as bytes (uint32, float32)."""
    n = len(offsets) - 1
    start, end, row, word = distinct_words(offsets, data)
    bucket, owner = word_grams(data, start, end, orders, bits)
    by = np.argsort(owner, kind="stable")
    bucket = bucket[by]
    size = np.bincount(owner, minlength=len(start))
    first = np.cumsum(size) - size
    count = size[word]
    at = np.repeat(first[word] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key, value = np.unique((np.repeat(row, count) << bits) | bucket[at], return_counts=True)
    cut = np.searchsorted(key >> bits, np.arange(n + 1))
    low, value = (key & ((1 << bits) - 1)).astype(np.uint32), value.astype(np.float32)
    return {"idx": pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), "val": pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())}
