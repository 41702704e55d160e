"""Suffix arrays by induced sorting (Nong, Zhang & Chan 2009) and permuted common prefixes (Karkkainen et al. 2009)."""

from __future__ import annotations

import numpy as np


def suffix_types(a: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S-type); the last symbol is the unique smallest."""
    n = len(a)
    step = np.sign(a[1:] - a[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return out


def suffix_array(a: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``a`` (int64 symbols below ``sigma``) whose last symbol is a unique smallest 0."""
    n = len(a)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = suffix_types(a)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(a, minlength=sigma)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    s, is_small = a.tolist(), small.tolist()

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        at = tails.copy()
        for i in reversed(seeds):
            c = s[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads.copy()
        for j in sa:  # grows ahead of the cursor: larger suffixes from the left
            if j > 0 and not is_small[j - 1]:
                c = s[j - 1]
                sa[at[c]] = j - 1
                at[c] += 1
        at = tails.copy()
        for k in range(n - 1, -1, -1):  # smaller suffixes from the right
            j = sa[k]
            if j > 0 and is_small[j - 1]:
                c = s[j - 1]
                at[c] -= 1
                sa[at[c]] = j - 1
        return sa

    order = np.array(induce(lms.tolist()))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    stop = np.full(n, n - 1)
    stop[lms[:-1]] = lms[1:]
    names, last, name = np.zeros(n, np.int64), None, -1
    stops = stop.tolist()
    for i in order.tolist():  # equal neighbours share a name
        piece = s[i : stops[i] + 1]
        if piece != last:
            name += 1
            last = piece
        names[i] = name
    reduced = names[lms]
    if name + 1 == len(lms):
        rank = np.empty(len(lms), np.int64)
        rank[reduced] = np.arange(len(lms))
    else:
        rank = suffix_array(reduced, name + 1)
    return np.array(induce(lms[rank].tolist()))


def permuted_lcp(a: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every position the common prefix, in symbols, with its predecessor in suffix order (0 for the first)."""
    n = len(a)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    s, before, out, length = a.tolist(), phi.tolist(), [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        while s[i + length] == s[j + length]:  # ends: the last symbol is unique
            length += 1
        out[i] = length
        if length:
            length -= 1
    return np.array(out)
