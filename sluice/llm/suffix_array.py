"""Suffix arrays by the difference-cover algorithm, in numpy."""

from __future__ import annotations

import numpy as np


def _names(keys: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Names of tuples by their order, from 1; the number of different names."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return names, int(new.sum()) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (numbers from 1 up) in order; a suffix is before its extensions.

    The triples at positions that 3 doesn't divide are sorted and named; if names repeat, the suffixes of the
    string of names are sorted by the same algorithm.  The others are sorted by their first symbol and the
    rank of what follows, and merged in.
    """
    s, n = s.astype(np.int64), len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.r_[s, 0, 0, 0]
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.r_[one, two]
    top = int(s.max())
    if top < 1 << 21:
        keys = [(padded[sampled] << 42) | (padded[sampled + 1] << 21) | padded[sampled + 2]]
    else:
        keys = [padded[sampled], padded[sampled + 1], padded[sampled + 2]]
    names, different = _names(keys)
    if different == len(sampled):
        order = np.argsort(names)
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    sorted_sample = sampled[order]
    rank[sorted_sample] = np.arange(1, len(sampled) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    bits = int(len(sampled) + 1).bit_length()
    first = lambda i: (padded[i] << bits) | rank[i + 1]
    rest = rest[np.argsort(first(rest), kind="stable")]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(first(ones), first(rest))
    pair_bits = top.bit_length() * 2 + bits
    if pair_bits <= 63:
        second = lambda i: (((padded[i] << top.bit_length()) | padded[i + 1]) << bits) | rank[i + 2]
        before = before + np.searchsorted(second(twos), second(rest))
    else:
        every = np.r_[twos, rest]
        name, _ = _names([padded[every], padded[every + 1], rank[every + 2]])
        before = before + np.searchsorted(name[: len(twos)], name[len(twos) :])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sorted_sample
    return out


def equal_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start but the first: whether ``length`` (8 or more) bytes there equal those at the start before."""
    words = np.zeros(len(data), np.uint64)
    for j in range(8):
        words[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(8 * j)
    a, b = starts[:-1], starts[1:]
    live = np.arange(len(a))
    for k in [*range(0, length - 8, 8), length - 8]:
        live = live[words[a[live] + k] == words[b[live] + k]]
    same = np.zeros(len(starts), bool)
    same[live + 1] = True
    return same
