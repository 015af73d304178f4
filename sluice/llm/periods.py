"""Periodic runs of words, and texts with each run cut back to its first period.

A run is a longest stretch of words with smallest period ``q`` and a length of at least ``LEAST`` words and ``TIMES``
periods.  At its end stands a square ``ww`` of ``|w| = q`` that the next word doesn't prolong, a branching
square: the longest common prefix of the suffixes at its two halves is ``q`` words exactly, so they are in different
children of the LCP interval of depth ``q``.  The intervals are read off the LCP array as pairs of neighbouring ranges of
ranks (an interval of many children is several such pairs of one depth); for each suffix ``i`` of the smaller range the
inverse suffix array tells whether ``i + q`` or ``i - q`` is in the other one.  No nodes are kept and every branching
square is found once.  A square is then rotated left as far as the period holds, which gives the whole run; squares of
several periods of one run end at the same word and are merged into it.

The suffix array is that of many documents behind each other, with a word of two documents as two symbols, so no
interval spans documents.  Documents of which no window of ``WINDOW`` words occurs twice can't hold a run and
are passed by: the two halves of a run's overlap with itself, one period on, share that many words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bound
from sluice.llm.suffix_array import suffix_array
from sluice.shipping import ship

#: Least words, and least periods, of a run.
LEAST, TIMES = 24, 3
#: Words that a run shares with itself one period on: 24 - 8 for periods up to 8, twice the period (18 or more) beyond.
WINDOW = LEAST - LEAST // TIMES
#: Words of documents that are looked at together; a longer document is looked at alone.
TOGETHER = 400_000
#: Suffixes that are tested at once.
AT_ONCE = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lcp_array(s: np.ndarray, sa: np.ndarray, isa: np.ndarray) -> list[int]:
    """Longest common prefix of each suffix in order with the one before; 0 for the first."""
    symbols, order = [*s.tolist(), -1], sa.tolist()
    lcp, shared = [0] * len(order), 0
    for i, r in enumerate(isa.tolist()):
        if not r:
            shared = 0
            continue
        j = order[r - 1]
        while symbols[i + shared] == symbols[j + shared]:
            shared += 1
        lcp[r] = shared
        if shared:
            shared -= 1
    return lcp


def neighbour_ranges(lcp: list[int]) -> np.ndarray:
    """Rows ``depth, low, middle, high``: suffixes of ranks ``[low, middle)`` and ``[middle, high)`` share just ``depth`` symbols, for depths above 0."""
    low, high, stack = [0] * len(lcp), [len(lcp)] * len(lcp), []
    for j, depth in enumerate(lcp):
        while stack and lcp[stack[-1]] > depth:
            high[stack.pop()] = j
        low[j] = stack[-1] if stack else 0
        stack.append(j)
    found = np.array([lcp, low, range(len(lcp)), high], np.int64)
    return found[:, found[0] > 0]


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of the squares of ``s`` that the next symbol doesn't prolong."""
    sa = suffix_array(s)
    n = len(s)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    depth, low, middle, high = neighbour_ranges(lcp_array(s, sa, isa))
    left = middle - low <= high - middle
    begin, size = np.where(left, low, middle), np.where(left, middle - low, high - middle)
    other_low, other_high = np.where(left, middle, low), np.where(left, high, middle)
    starts, halves = [], []
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + AT_ONCE, side="right")))
        for a, b in _pieces(at, to, size):  # of one range that is longer than what is tested at once
            node = np.repeat(np.arange(at, to), size[at:to]) if to > at + 1 else np.full(b - a, at)
            offset = np.arange(a, b) - (np.repeat(upto[at:to] - size[at:to] - done, size[at:to]) if to > at + 1 else 0)
            i, d = sa[begin[node] + offset], depth[node]
            for first, second in ((i, i + d), (i - d, i)):
                probe = second if first is i else first
                inside = (probe >= 0) & (probe < n)
                rank = isa[np.where(inside, probe, 0)]
                hit = inside & (rank >= other_low[node]) & (rank < other_high[node])
                starts.append(first[hit]), halves.append(d[hit])
        at = to
    return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(halves or [np.empty(0, np.int64)])


def _pieces(at: int, to: int, size: np.ndarray) -> Iterator[tuple[int, int]]:
    total = int(size[at:to].sum())
    if to > at + 1:
        yield 0, total
    else:
        for a in range(0, total, AT_ONCE):
            yield a, min(total, a + AT_ONCE)


def _rotated(s: np.ndarray, start: int, period: int, first: int) -> int:
    """The least place, ``first`` at the lowest, from which on ``period`` holds up to ``start``."""
    step = 16
    while start > first:
        a = max(first, start - step)
        differ = np.flatnonzero(s[a:start] != s[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, 2 * step
    return start


def runs_of(s: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of each run, by start, then period; ``first`` is the first place of each symbol's document."""
    starts, halves = branching_squares(s)
    order = np.argsort(halves, kind="stable")
    by_end: dict[int, list[int]] = {}
    found = []
    for start, q in zip(starts[order].tolist(), halves[order].tolist()):
        end = start + 2 * q
        known = by_end.setdefault(end, [])
        if any(begin <= start for begin in known):
            continue  # several periods of a run that has been found
        begin = _rotated(s, start, q, int(first[start]))
        known.append(begin)
        if end - begin >= max(LEAST, TIMES * q):
            found.append((begin, end - begin, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _may_hold(ids: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Numbers of the documents of which a window of ``WINDOW`` words occurs twice, by hashes: some more, but none is left out."""
    if len(ids) < LEAST:
        return np.empty(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    total = mixed.copy()
    width = 1
    while 2 * width <= WINDOW:  # of windows of twice the width
        total = total[:-width] * _ODD + (total[width:] ^ (total[width:] >> np.uint64(31)))
        width *= 2
    whole = document[: len(total)] == document[width - 1 :]
    value = (total * _ODD + document[: len(total)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[whole]
    order = np.argsort(value)
    twice = np.flatnonzero(value[order][1:] == value[order][:-1])
    return np.unique(document[: len(total)][whole][order[twice]])


def find_in(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document, given as lists of words."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for d in documents for w in d), np.int64, int(sizes.sum()))
    document = np.repeat(np.arange(len(documents)), sizes)
    some = _may_hold(ids, document)
    if not len(some):
        return found
    chosen = np.isin(document, some)
    ids, document = ids[chosen], document[chosen]
    # A word of two documents is two symbols.
    s = np.unique(document * len(number) + ids, return_inverse=True)[1].astype(np.int64) + 1
    opens = np.r_[True, document[1:] != document[:-1]]
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    for start, length, period in runs_of(s, first):
        found[document[start]].append((start - int(first[start]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run holds beyond its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, k in zip(words, np.cumsum(gone).tolist()) if not k]


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, runs, collapsed`` for every row: the runs by start, then period, and the words that are kept, joined by one space.

    Words are runs of bytes other than ASCII white space.  Null and empty texts have no words, no runs and an empty
    ``collapsed``.  One narrow pass without shuffle over whole texts, however long; a text of ``n`` words takes memory in
    proportion to ``n``.  Null keys, ties and repeated rows are returned row by row; other columns, whatever their
    names, are not read.  An empty table gives an empty result.
    """
    ship(df.sparkSession)
    runs = "array<struct<start: long, length: long, period: long>>"
    names = ["k", "n_words", "runs", "collapsed"]

    def finished(keys: list, documents: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
        found = find_in(documents)
        kept = [b" ".join(collapsed(d, r)) for d, r in zip(documents, found)]
        as_rows = [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found]
        columns = [pa.array(keys, kind), pa.array([len(d) for d in documents], pa.int64()), pa.array(as_rows, pa.list_(RUN)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, documents, room = [], [], TOGETHER
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or b"").split()
                if documents and len(words) > room:
                    yield finished(keys, documents, kind)
                    keys, documents, room = [], [], TOGETHER
                keys.append(k), documents.append(words)
                room -= len(words)
            if documents:
                yield finished(keys, documents, kind)

    out = df.select(df[key].alias("k"), df[text].cast("string").cast("binary").alias("t"))
    made = out.mapInArrow(batches_of, f"k {df.schema[key].dataType.simpleString()}, n_words long, runs {runs}, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string")).withColumnRenamed("k", key)


def strongest(runs: Column) -> Column:
    """The run of greatest length by period, compared exactly; ties go to the least start, then period; null without runs.

    ``runs`` are by start, then period, so the first of equals is taken.
    """
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return bound(runs, lambda r: F.aggregate(r, F.get(r, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))


def planted(df: DataFrame, words: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text``, where each tenth text by hash repeats some of its words from some place on to its end.

    With ``h`` the CRC-32 of the key in decimal and ``g = h div 10``: if 10 divides ``h``, word ``i >= a`` of ``n`` becomes word
    ``a + (i - a) % p``, with ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``.  Other texts, and those without words, stay.
    """
    h = F.crc32(df[key].cast("string").cast("binary"))
    rows = df.select(df[key].alias("k"), df[text].cast("string").alias("t"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))

    def repeated(found: Column) -> Column:
        n = F.size(found).cast("long")
        return F.when(n == 0, F.col("t")).otherwise(bound(F.col("g") % n, lambda a: _periodic(found, n, a)))

    def _periodic(found: Column, n: Column, a: Column) -> Column:
        p = F.floor((n - a) / (3 + F.col("g") % 8)).cast("long") + 1
        return bound(p, lambda q: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % q).cast("int"))), " "))

    found = F.regexp_extract_all("t", F.lit(words), F.lit(0))
    return rows.select(F.col("k").alias(key), F.when(F.col("h") % 10 == 0, bound(found, repeated)).otherwise(F.col("t")).alias(text))
