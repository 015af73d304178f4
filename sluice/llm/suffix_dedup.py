"""Removal of repeated substrings by distributed difference-cover suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed.

1. *Dealing.*  Windows of ``LENGTH`` bytes are dealt out by content: each belongs to its minimizer, the least hash
   among its ``GRAM``-byte strings, so equal windows meet whatever document they are in.  A run of
   consecutive windows of one minimizer is a *context*: some 40 windows, 140 bytes.  What travels is two hashes
   and a place for each context; a task sends only the first of its equal contexts, as the others are known
   to repeat, so a passage of any number of documents sends one row for each task.
2. *Equal contexts.*  In a shuffle by minimizer all but the first of equal contexts are marked as repeats.
   Minimizers of one context only end here; most windows are neither repeated nor sorted.
3. *Suffix sorting.*  Equal windows hold their minimizer at one place, and with it the ``SIDE`` bytes before it or those
   behind it.  So only contexts of a minimizer that have either in common with a different one fetch their bytes; those
   that merely share a minimizer of ``GRAM`` bytes don't.  They are sorted by the
   difference-cover algorithm (triples at sampled positions, recursion on their names, merging of the other
   suffixes, see ``suffix_array``), partition by partition, and adjacent suffixes are compared on their first
   ``LENGTH`` bytes: of equal ones all but the earliest window are marked.
4. *Cutting.*  Marks go to their documents, and marked windows are cut out of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut
from sluice.llm.shingling import _buffers as text_buffers
from sluice.llm.shingling import _power, mix
from sluice.llm.suffix_array import equal_prefixes, suffix_array
from sluice.shipping import ship

LENGTH, GRAM = 100, 16
#: Windows that are hashed at once (texts are taken in pieces of this many), contexts that a task holds before it
#: sends them, and bytes of contexts that are suffix-sorted at once (more only for a single minimizer).
PIECE, HELD, SORTED = 1 << 20, 400_000, 1_000_000
#: Document ids up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
_U = np.uint64
_rng = np.random.default_rng(77)
_GRAM_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CONTEXT_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_UNBASES = tuple(pow(b, -1, 2**64) for b in _BASES)
_PLACE_BITS = 24
#: Bytes on one side of a minimizer that a window surely holds: whatever its place, there are so many before or behind it.
SIDE = (LENGTH - GRAM) // 2
NULL_ID = 2**63 - 1


def _sums(data: np.ndarray, table: np.ndarray, way: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(_BASES[way], len(data))[: len(data)], out=out[1:])
    return out


def contexts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts side by side: ``text, start, windows, minimizer, hash, left, right`` of each context, in order of place.

    ``start`` is the first window's place in ``data``.  A minimizer is known by the hash of its string, a context
    by that of its bytes; ``left`` and ``right`` are hashes of the minimizer with the ``SIDE`` bytes before and behind it, 0
    where the context ends sooner.
    """
    windows = np.diff(off) - LENGTH + 1
    if not (windows > 0).any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32))
    n, wide = len(data), LENGTH - GRAM + 1
    inverse = _power(_UNBASES[0], n)
    sums = _sums(data, _GRAM_BYTE, 0)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    key = (gram >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
    # Least key of each run of ``wide``: the lesser of a running minimum to the right and one to the left, by blocks.
    blocks = -(-len(key) // wide)
    full = np.full(blocks * wide, ~_U(0))
    full[: len(key)] = key
    right = np.minimum.accumulate(full.reshape(blocks, wide), axis=1).ravel()
    left = np.minimum.accumulate(full.reshape(blocks, wide)[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - wide + 1
    least = np.minimum(left[:count], right[wide - 1 : wide - 1 + count]) & _U((1 << _PLACE_BITS) - 1)
    doc = np.repeat(np.arange(len(windows)), np.maximum(windows, 0))
    begin = np.cumsum(np.maximum(windows, 0)) - np.maximum(windows, 0)
    place = np.arange(len(doc)) - begin[doc] + off[:-1][doc]
    mine = least[place]
    new = np.r_[True, (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, len(doc)])
    start = place[at]
    whole = _sums(data, _CONTEXT_BYTE, 1)
    ends = start + length - 1 + LENGTH
    context = mix((whole[ends] - whole[start]) * _power(_UNBASES[1], n)[start], 5) + mix(length.astype(np.uint64), 6)
    middle = mine[at].astype(np.int64)
    left = _side(whole, np.where(middle - SIDE >= start, middle - SIDE, -1))
    right = _side(whole, np.where(middle + GRAM + SIDE <= ends, middle, -1))
    return doc[at], start, length, gram[middle], context, left, right


def _side(sums: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes, never 0, of the strings of ``GRAM + SIDE`` bytes that begin there, 0 for a begin of -1."""
    there = np.flatnonzero(begin >= 0)
    out, a = np.zeros(len(begin), np.uint32), begin[there]
    out[there] = (mix((sums[a + GRAM + SIDE] - sums[a]) * _power(_UNBASES[1], len(sums))[a], 7) >> _U(32)).astype(np.uint32) | np.uint32(1)
    return out


def _met(minimizer: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether other rows have the same minimizer and side, which must be there."""
    order = np.lexsort((side, minimizer))
    m, s = minimizer[order], side[order]
    same = np.zeros(len(m) + 1, bool)
    same[1:-1] = (m[1:] == m[:-1]) & (s[1:] == s[:-1]) & (s[1:] != 0)
    out = np.empty(len(m), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """``first text, base, bytes, offsets, shift``: texts side by side, or a piece of a long one with the windows that begin in it."""
    data, off = text_buffers(texts)
    first = 0
    while first < len(off) - 1:
        if off[first + 1] - off[first] > PIECE:
            for at in range(off[first], off[first + 1], PIECE):
                to = min(at + PIECE + LENGTH - 1, off[first + 1])
                yield first, data[at:to], np.array([0, to - at]), at - off[first]
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(off, off[first] + PIECE, side="right")) - 1)
        yield first, data[off[first] : off[last]], off[first : last + 1] - off[first], 0
        first = last


COLUMNS = {"minimizer": "<u8", "context": "<u8", "doc": "<i8", "twin": "<i8", "start": "<i8", "windows": "<i4", "left": "<u4", "right": "<u4"}


def _sent(kind: int, to: int, rows: dict[str, np.ndarray]) -> dict:
    return {"kind": kind, "to": to} | {c: rows[c].astype(t).tobytes() for c, t in COLUMNS.items()}


def _dealt(kind: int, to: np.ndarray, rows: dict[str, np.ndarray], parts: int) -> list[dict]:
    """One row for each partition that something goes to; columns that are empty stay so."""
    order = np.argsort(to.astype(np.int64), kind="stable")
    edges = np.searchsorted(to.astype(np.int64)[order], np.arange(parts + 1))
    each = ((k, order[edges[k] : edges[k + 1]]) for k in range(parts) if edges[k] < edges[k + 1])
    return [_sent(kind, k, {c: v[at] if len(v) else v for c, v in rows.items()}) for k, at in each]


def _marks(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Marked windows by document: id, hash of its text, and pairs of first window and number of windows."""
    if not len(rows["doc"]):
        return
    order = np.lexsort((rows["start"], rows["twin"], rows["doc"]))
    doc, twin = rows["doc"][order], rows["twin"][order]
    pairs = np.stack([rows["start"][order], rows["windows"][order]], axis=1).astype("<i8")
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
    for a, b in zip(at, np.r_[at[1:], len(doc)]):
        yield int(doc[a]), int(twin[a]), pairs[a:b].tobytes()


def _take(rows: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in rows.items()}


def _firsts(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows by minimizer, context and place; whether each is the first of its minimizer and context."""
    order = np.lexsort((rows["start"], rows["twin"], rows["doc"], rows["context"], rows["minimizer"]))
    rows = _take(rows, order)
    m, c = rows["minimizer"], rows["context"]
    return rows, np.r_[True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])][: len(m)]


def _same_place(rows: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Rows at the very place of their first: a repeated row of the table, which repeats nothing earlier."""
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (rows["doc"] == rows["doc"][lead]) & (rows["twin"] == rows["twin"][lead]) & (rows["start"] == rows["start"][lead])


def mark_contexts(docs: DataFrame, parts: int) -> DataFrame:
    """Steps 1 and 2: ``kind`` 1 marks of a document (``doc, twin, marks``), ``kind`` 2 contexts to be sorted (``doc, twin, minimizer, marks``)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pd.DataFrame]:
            rows = {c: np.concatenate([h[c] for h in held]) for c in COLUMNS} if held else None
            held.clear()
            if rows is None or not len(rows["doc"]):
                return
            rows, first = _firsts(rows)
            known = _take(rows, np.flatnonzero(~first & ~_same_place(rows, first)))
            rows = _take(rows, np.flatnonzero(first))
            for c in ("minimizer", "context", "left", "right"):
                known[c] = np.empty(0, COLUMNS[c])  # a mark is a place
            out = _dealt(0, (rows["minimizer"] >> _U(20)) % _U(parts), rows, parts)
            yield pd.DataFrame(out + _dealt(1, known["doc"] % parts, known, parts))

        for b in batches:
            ids, twins = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, data, off, shift in _pieces(b.column(2)):
                doc, start, windows, minimizer, context, left, right = contexts(data, off)
                held.append({"minimizer": minimizer, "context": context, "doc": ids[first + doc], "twin": twins[first + doc], "start": start - off[doc] + shift, "windows": windows, "left": left, "right": right})
            if sum(len(h["doc"]) for h in held) >= HELD:
                yield from flush()
        yield from flush()

    def arrow(frames: Iterator[pd.DataFrame], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_pandas(f, schema, preserve_index=False)

    sent = pa.schema([("kind", pa.int32()), ("to", pa.int32()), *((c, pa.binary()) for c in COLUMNS)])
    told = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("twin", pa.int64()), ("minimizer", pa.int64()), ("marks", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[dict[str, np.ndarray]]] = {0: [], 1: []}
        for b in batches:
            for k, *columns in zip(b.column(0).to_pylist(), *(b.column(i + 2) for i in range(len(COLUMNS)))):
                of[k].append({c: np.frombuffer(x.as_buffer(), t) for x, (c, t) in zip(columns, COLUMNS.items())})
        out = []
        for r in of[1]:
            out += [(1, d, t, None, m) for d, t, m in _marks(r)]
        if of[0]:
            rows, first = _firsts({c: np.concatenate([r[c] for r in of[0]]) for c in COLUMNS})
            of[0].clear()
            out += [(1, d, t, None, m) for d, t, m in _marks(_take(rows, np.flatnonzero(~first & ~_same_place(rows, first))))]
            rows = _take(rows, np.flatnonzero(first))
            m = rows["minimizer"]
            several = _take(rows, np.flatnonzero(_met(m, rows["left"]) | _met(m, rows["right"])))
            pairs = np.stack([several["start"], several["windows"]], axis=1).astype("<i8")
            out += [(2, int(d), int(t), int(x), p.tobytes()) for d, t, x, p in zip(several["doc"], several["twin"], several["minimizer"].view(np.int64), pairs)]
        for at in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 20_000]), told.types)], schema=told)

    spread = docs.mapInArrow(lambda batches: arrow(deal(batches), sent), "kind int, to int, " + ", ".join(f"{c} binary" for c in COLUMNS))
    return spread.repartition(parts, "to").mapInArrow(meet, "kind int, doc long, twin long, minimizer long, marks binary")


def mark_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 for the contexts of whole minimizers in one partition: marks of windows that start earlier elsewhere."""
    told = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("marks", pa.binary())])
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    ids = [table.column(c).to_numpy() for c in range(4)]
    minimizer, doc, twin, start = ids
    order = np.lexsort((start, twin, doc, minimizer))
    data, off = text_buffers(table.column(4).combine_chunks())
    size = np.diff(off)[order]
    edges = np.flatnonzero(np.r_[True, minimizer[order][1:] != minimizer[order][:-1], True])
    group = 0
    while group < len(edges) - 1:
        to, total = group, 0
        while to < len(edges) - 1 and (to == group or total + size[edges[to] : edges[to + 1]].sum() <= SORTED):
            total += size[edges[to] : edges[to + 1]].sum()
            to += 1
        pick = order[edges[group] : edges[to]]
        group = to
        # Contexts side by side, each behind a separator that no byte equals.
        each = size[: 0] if not len(pick) else np.diff(off)[pick]
        base = np.cumsum(each + 1) - each
        joined = np.ones(int((each + 1).sum()), np.int64)
        raw = np.zeros(len(joined) + 8, np.uint8)
        for b, p, n in zip(base, pick, each):
            joined[b : b + n] = data[off[p] : off[p + 1]].astype(np.int64) + 2
            raw[b : b + n] = data[off[p] : off[p + 1]]
        windows = each - LENGTH + 1
        owner = np.repeat(np.arange(len(pick)), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        number = np.full(len(joined), -1, np.int64)
        number[base[owner] + inside] = np.arange(len(owner))
        suffixes = suffix_array(joined)
        suffixes = suffixes[number[suffixes] >= 0]
        window = number[suffixes]
        group_id = np.cumsum(~equal_prefixes(raw, suffixes, LENGTH))
        # Contexts are in order of place, so the earliest of equal windows has the least document, then start.
        where = start[pick][owner[window]] + inside[window]
        by_place = np.lexsort((where, twin[pick][owner[window]], doc[pick][owner[window]], group_id))
        lead = np.r_[True, group_id[by_place][1:] != group_id[by_place][:-1]]
        rows = {"doc": doc[pick][owner[window]][by_place], "twin": twin[pick][owner[window]][by_place], "start": where[by_place]}
        rows["windows"] = np.ones(len(lead), np.int64)
        later = np.flatnonzero(~lead & ~_same_place(rows, lead))
        out = [(d, t, _runs(m)) for d, t, m in _marks(_take(rows, later))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), told.types)], schema=told)


def _runs(marks: bytes) -> bytes:
    """Single windows joined into runs."""
    starts = np.frombuffer(marks, "<i8").reshape(-1, 2)[:, 0]
    at = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    return np.stack([starts[at], np.diff(np.r_[at, len(starts)])], axis=1).astype("<i8").tobytes()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are named beside a text."""
    told = pa.schema([("minimizer", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
    for b in batches:
        out = []
        for doc, twin, text, minimizers, places in zip(*(c.to_pylist() for c in b.columns)):
            text = text.encode()
            for m, p in zip(minimizers, places):
                start, windows = np.frombuffer(p, "<i8")
                out.append((m, doc, twin, int(start), text[start : start + windows + LENGTH - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), told.types)] if out else [pa.array([], t) for t in told.types], schema=told)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, marks in zip(*(c.to_pylist() for c in b.columns)):
            raw = (text or "").encode()
            if not marks:
                out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text))
                continue
            pairs = np.concatenate([np.frombuffer(m, "<i8").reshape(-1, 2) for m in marks])
            turn = np.zeros(len(raw) + 1, np.int64)
            np.add.at(turn, pairs[:, 0], 1)
            np.add.at(turn, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
            gone = np.cumsum(turn[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``; see the module.

    A null text is empty; texts below ``LENGTH`` bytes lose nothing; matches never cross documents and are judged
    on the input.  A null id comes after all others.  Rows equal in id and text are one document, so that a
    repeated row is not removed for its twin; rows of one id and different texts are ordered by a hash of the text.
    ``kept`` is what is left, bytes that no longer form characters replaced.  An empty table gives an empty
    result.  Only the two named columns are read.
    """
    ship(docs.sparkSession)
    read = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    keyed = read.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("twin"), "text", "doc_id")
    parts = max(8, read.rdd.getNumPartitions())
    told = cut(mark_contexts(keyed.select("doc", "twin", "text"), parts), "context-marks")
    wanted = told.where("kind = 2").groupBy("doc", "twin").agg(F.collect_list(F.struct("minimizer", "marks")).alias("wanted"))
    wanted = cut(wanted.select("doc", "twin", F.col("wanted.minimizer").alias("minimizers"), F.col("wanted.marks").alias("places")), "wanted-contexts")
    texts = keyed.select("doc", "twin", "text")
    named = wanted.select("doc", "twin")
    if named.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(named), ["doc", "twin"], "left_semi")
    fetched = texts.dropDuplicates(["doc", "twin"]).join(wanted, ["doc", "twin"]).select("doc", "twin", "text", "minimizers", "places")
    fetched = fetched.mapInArrow(_fetch, "minimizer long, doc long, twin long, start long, bytes binary")
    more = fetched.repartition(parts, "minimizer").mapInArrow(mark_sorted, "doc long, twin long, marks binary")
    marks = told.where("kind = 1").select("doc", "twin", "marks").unionByName(more).groupBy("doc", "twin").agg(F.collect_list("marks").alias("marks"))
    return keyed.join(marks, ["doc", "twin"], "left").select("doc_id", "text", "marks").mapInArrow(
        _cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
