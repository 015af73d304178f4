"""Hashed word shingles of whole Arrow batches of texts, in numpy, without an object for any word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

N = 5
#: Bytes of texts that are hashed at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20_24)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[_SPACE] = 0
_BYTE = _BYTE[_LOWER]
_PLACE = _rng.integers(1, 2**63, N + 1, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _U(salt * 0x632BE59BD9B4E019 % 2**64)
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        _powers[key] = np.cumprod(np.full(max(n, STEP_BYTES), base, dtype=np.uint64))
    return _powers[key]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), off


def steps(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, hashes, counts``: the distinct shingles of texts ``first`` to ``last``, by text, then hash.

    A text with fewer than five words has the whole sequence as its one shingle, one without words none.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    """
    data, off = _buffers(texts)
    first = 0
    while first < len(off) - 1:
        last = int(np.searchsorted(off, off[first] + STEP_BYTES, side="right")) - 1
        last = min(max(last, first + 1), first + 60_000, len(off) - 1)
        yield first, last, *_distinct(data[off[first] : off[last]], off[first : last + 1] - off[first])
        first = last


def _distinct(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs = len(off) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    start[edge] = solid[edge]
    starts = np.flatnonzero(start)
    per = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    word = np.add.reduceat(_BYTE[data] * _power(_BASE, len(data))[: len(data)], starts) * _power(_UNBASE, len(data))[starts]
    word = mix(word)
    owner = np.repeat(np.arange(docs), per)
    total = np.zeros(len(word), np.uint64)
    for j in range(N):
        if j < len(word):
            total[: len(word) - j] += word[j:] * _PLACE[j]
    place = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
    full = place + N <= per[owner]
    hashes, owners = mix(total[full]), owner[full]
    short = np.flatnonzero((per > 0) & (per < N))
    if len(short):
        begin = (np.cumsum(per) - per)[short]
        of = np.zeros(len(short), np.uint64)
        for j in range(N - 1):
            has = j < per[short]
            of[has] += word[begin[has] + j] * _PLACE[j]
        hashes = np.r_[hashes, mix(of + per[short].astype(np.uint64) * _PLACE[N], 1)]
        owners = np.r_[owners, short]
    order = np.argsort(hashes)
    order = order[np.argsort(owners[order].astype(np.uint16), kind="stable")]
    hashes, owners = hashes[order], owners[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])] if len(hashes) else np.empty(0, bool)
    return hashes[new], np.bincount(owners[new], minlength=docs)
