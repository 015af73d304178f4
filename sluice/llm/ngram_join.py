"""Similarity join of documents by the Jaccard similarity of their word shingles.

1. Every text becomes its set of hashed five-word shingles.  How often each shingle occurs is counted over all
   documents in a count-min table of fixed size (``SLOTS`` counters), summed over tasks.
2. Documents of equal sets are one class, represented by its least id.  A class orders its shingles rare first
   and keeps the prefix in which two similar sets must share one: ``n - ceil(0.8 n) + 1`` of them.
3. Prefix shingles meet by shuffle.  In a first round each document meets only its neighbour by size among those
   that share a shingle and the one of least id, mostly the text that the others are copies of, so a shingle
   of ``k`` documents gives fewer than ``2 k`` pairs.  Verified links give components.
   In a second round documents of different components that share a shingle meet; what is in one component
   already needs no further link.  So the components are exact, though most pairs of a hot group never arise.
   Shingles of many documents are dealt to pairs of blocks, pairs that fail a filter are never written, and
   those that pass are written at the least shingle they have in common, as far as sketches of ``SKETCH``
   shingles tell it.
4. A pair must pass the length filter, the positional filter (what precedes and follows a common shingle in both
   sets bounds the overlap) and the suffix filter (the difference of counts in ``RANGES`` ranges of hash values
   bounds the Hamming distance from below, and so does the number of ``CELLS`` finer ranges whose counts are odd in one
   of the sets only, which tells apart what near misses of one family have in common); pairs are made distinct, then
   verified once from the two texts: by their hashed sets, and if these are similar by the shingles themselves.

Shingles that the count-min table shows as frequent are dealt to ``SALTS`` tasks; their count and least document come
from a partial aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import shingling
from sluice.llm.common import cut
from sluice.llm.components import components
from sluice.shipping import ship

#: Similarity as a fraction of two integers.
NUMER, DENOM = 80, 100
#: Counters of the table of shingle counts, in blocks that are summed apart; ranges of the suffix filter, by counts and
#: by parities, and the bytes of both.
SLOTS, BLOCK = 1 << 20, 1 << 14
RANGES, CELLS = 128, 1024
WIDTH = RANGES + CELLS // 8
#: A shingle may be hot from this many documents and this many times the mean counter on; it is then dealt to so many tasks.
HOT_DOCUMENTS, HOT_TIMES, SALTS = 1000, 8, 16
#: Documents of a shingle that meet in one group of the second round; more are dealt to pairs of blocks.
MEETING = 512
#: Least shared shingles of a document that its rows carry in the second round, and what stands for none.
SKETCH, NONE = 16, 2**63 - 1
#: Ids (8 bytes) up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def shingle_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each slot the number of (document, shingle) pairs that fall in it, as a byte on a logarithmic scale."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, _, hashes, _ in shingling.steps(b.column(0)):
                total += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = total.astype("<u4").reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK, np.int64)
        for p in parts:
            for x in p["counts"]:
                total += np.frombuffer(x, "<u4")
        yield pd.DataFrame({"block": [key[0]], "scale": [np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8).tobytes()]})

    counted = docs.select(docs[text].cast("string").alias("t")).mapInArrow(count, "block int, counts binary")
    rows = counted.groupBy("block").applyInPandas(add, "block int, scale binary").collect()  # SLOTS bytes in all
    scale = np.zeros(SLOTS, np.uint8)
    for r in rows:
        scale[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["scale"], np.uint8)
    return scale


def _profile(h: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """For each set, whose hashes are sorted, its counts by range, then a bit for each cell of an odd count."""
    out = np.zeros((docs, WIDTH), np.uint8)
    at = owner * RANGES + (h >> np.uint64(57)).astype(np.int64)
    out[:, :RANGES] = np.minimum(np.bincount(at, minlength=docs * RANGES), 255).reshape(docs, RANGES)
    cell = owner * CELLS + (h >> np.uint64(54)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    odd = cell[begin[np.diff(np.r_[begin, len(cell)]) % 2 == 1]]
    np.bitwise_or.at(out, (odd // CELLS, RANGES + odd % CELLS // 8), (1 << odd % 8).astype(np.uint8))
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, s1, s2, prefix, often, ranges`` for every row: size and hash of the set, its rare-first prefix, which of it is hot, and its profile (see ``_profile``)."""
    spark = docs.sparkSession
    counts = shingle_counts(docs, text)
    mean = float(np.mean(np.exp2(counts / 8.0) - 1))
    hot = 8 * np.log2(1.0 + HOT_DOCUMENTS + HOT_TIMES * mean)
    scale = spark.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, h, n in shingling.steps(b.column(1)):
                docs_here, owner = last - first, np.repeat(np.arange(last - first), n)
                begin = np.r_[0, np.cumsum(n)[:-1]]
                some = n > 0
                sums = np.zeros((2, docs_here), np.uint64)
                for i in (0, 1):
                    if some.any():
                        sums[i, some] = np.add.reduceat(shingling.mix(h, i + 2), begin[some])
                ranges = _profile(h, owner, docs_here)
                rare = (scale.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order = np.argsort(rare, kind="stable")
                order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
                length = np.where(some, n - -(-n * NUMER // DENOM) + 1, 0)
                in_prefix = np.arange(len(h)) - np.repeat(begin, n) < np.repeat(length, n)
                values = h[order][in_prefix].view(np.int64)
                edges = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                prefix = pa.ListArray.from_arrays(edges, pa.array(values))
                often = pa.ListArray.from_arrays(edges, pa.array((rare[order][in_prefix] >> np.uint64(56)) >= hot))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, docs_here), pa.array(n.astype(np.int32)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), prefix, often, pa.array([r.tobytes() for r in ranges], pa.binary())],
                    ["id", "n", "s1", "s2", "prefix", "often", "ranges"],
                )

    read = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    return read.mapInArrow(sign, "id long, n int, s1 long, s2 long, prefix array<bigint>, often array<boolean>, ranges binary")


def _least_overlap(n1: Column, n2: Column) -> Column:
    return F.ceil((n1 + n2) * NUMER / (NUMER + DENOM))


def _may_link(a: str, b: str) -> Column:
    """Length and positional filter for a common shingle; set ``a`` is not the larger one."""
    col = lambda side, name: F.col(f"{side}{name}").cast("long")
    rest = F.least(col(a, "n") - col(a, "pos"), col(b, "n") - col(b, "pos"))  # with the common one
    return (col(a, "n") * DENOM >= col(b, "n") * NUMER) & (F.least(col(a, "pos"), col(b, "pos")) + rest >= _least_overlap(col(a, "n"), col(b, "n")))


def _suffix_filter(ra: np.ndarray, rb: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether profiles (pairs x WIDTH) leave room for the overlap that sets of ``total`` shingles need."""
    most = total - 2 * -(-total * NUMER // (NUMER + DENOM))
    near = np.abs(ra[:, :RANGES].astype(np.int16) - rb[:, :RANGES].astype(np.int16)).sum(1) <= most
    near[near] = np.bitwise_count(ra[near, RANGES:] ^ rb[near, RANGES:]).sum(1, dtype=np.int64) <= most[near]
    return near


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that pass all filters among rows sorted by group; a group that a batch cuts is carried over."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        last = (b[["h", "x", "y"]] == b[["h", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
        rest = b[last]
        yield _pairs(b[~last])
    if rest is not None:
        yield _pairs(rest)


def _pairs(b: pd.DataFrame) -> pd.DataFrame:
    found = [np.empty((2, 0), np.int64)]
    h, x, y, own, ids, n, pos, component = (b[c].to_numpy() for c in ("h", "x", "y", "own", "id", "n", "pos", "component"))
    ranges = np.frombuffer(b"".join(b["ranges"]), np.uint8).reshape(len(b), WIDTH)
    least_shared = np.concatenate(b["sketch"].to_numpy()).reshape(len(b), SKETCH)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    i, step = np.arange(len(b)), 0
    while len(i):
        step += 1
        i = i[i + step < len(b)]
        j = i + step
        same = (h[i] == h[j]) & (x[i] == x[j]) & (y[i] == y[j])
        i, j = i[same], j[same]
        least = -(-(n[i] + n[j]) * NUMER // (NUMER + DENOM))
        may = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * DENOM >= np.maximum(n[i], n[j]) * NUMER)
        may &= (own[i] != own[j]) | (x[i] == y[i])
        may &= np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
        a, c = i[may], j[may]
        near = _suffix_filter(ranges[a], ranges[c], n[a] + n[c])
        one, two = least_shared[a[near]], least_shared[c[near]]
        earlier = (one[:, :, None] == two[:, None, :]) & (one < h[a[near], None])[:, :, None]
        near[near] = ~earlier.any((1, 2))
        found.append(np.stack([np.minimum(ids[a[near]], ids[c[near]]), np.maximum(ids[a[near]], ids[c[near]])]))
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"]).drop_duplicates()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct ``a, b`` of ``pairs`` whose texts' shingle sets are similar."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[r]), np.uint8).reshape(len(p), WIDTH) for r in ("ra", "rb"))
                yield p.loc[_suffix_filter(x, y, (p["na"] + p["nb"]).to_numpy().astype(np.int64)), ["a", "b"]]

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_sets(b.column(2)), _sets(b.column(3))):  # a step of texts at a time on either side
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both * DENOM >= (len(x) + len(y) - both) * NUMER)
            for i in np.flatnonzero(keep):
                x, y = (_written(b.column(c)[int(i)].as_py()) for c in (2, 3))
                both = len(x & y)
                keep[i] = both > 0 and both * DENOM >= (len(x) + len(y) - both) * NUMER
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    info = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("ranges").alias(f"r{s}"))
    passed = cut(pairs.join(info("a"), "a").join(info("b"), "b").mapInPandas(near, "a long, b long"), "filtered-pairs").distinct()
    ids = cut(passed.select(F.col("a").alias("_id")).unionByName(passed.select(F.col("b").alias("_id"))).distinct(), "pair-ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(docs[key].cast("long").alias("_id"), docs[text].cast("string").alias("t")).join(ids, "_id", "left_semi")
    of = lambda s: texts.select(F.col("_id").alias(s), F.col("t").alias(f"t{s}"))
    both = passed.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(similar, "a long, b long").distinct()


def _written(text: str) -> set[bytes]:
    """The distinct shingles of a text as bytes, words joined by spaces; fewer than five words are one."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {b" ".join(words[i : i + shingling.N]) for i in range(max(len(words) - shingling.N + 1, 1))} if words else set()


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, h, n in shingling.steps(texts):
        yield from np.split(h, np.cumsum(n)[:-1])


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; see the module for the method.

    Two documents link at a Jaccard similarity of 80% or more; ``component_id`` is the least id that links
    lead to.  A text of fewer than five words is one shingle; null texts and texts without words have an
    empty set, link with nothing and are their own component.  Rows of one id are one document with several
    texts, linked if one of them is.  Rows of a null id take no part and have a null component.  An empty
    table gives an empty result.  Only the two named columns are read.
    """
    ship(docs.sparkSession)
    sets = cut(signatures(docs, key, text), "shingle-sets")
    real = sets.where("id IS NOT NULL AND n > 0")
    classes = cut(real.groupBy("s1", "s2").agg(F.min("id").alias("id")), "classes")
    own = real.join(classes, ["s1", "s2", "id"], "left_semi").dropDuplicates(["id", "s1", "s2"])
    shared = own.select("id", "n", F.posexplode(F.arrays_zip("prefix", "often")).alias("pos", "p")).select("id", "n", "pos", F.col("p.prefix").alias("h"), F.col("p.often").alias("often"))
    least = F.min(F.struct("id", "n", "pos"))
    # A counter is shared by many shingles, so those that only share it with a frequent one are told apart by their own count.
    hot = shared.where("often").groupBy("h").agg(F.count("*").alias("all"), least.alias("least")).where(F.col("all") >= HOT_DOCUMENTS)
    hot = cut(hot, "hot-shingles")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    shared = shared.join(hot, "h", "left").withColumn("salt", F.when(F.col("all").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0))
    together = Window.partitionBy("h", "salt")
    by_size = together.orderBy("n", "id")
    shared = shared.withColumns({"pid": F.lag("id").over(by_size), "pn": F.lag("n").over(by_size), "ppos": F.lag("pos").over(by_size), "k": F.coalesce("all", F.count("*").over(together)), "first": F.coalesce("least", least.over(together))})
    shared = shared.drop("salt", "often", "all", "least")
    shared = cut(shared.where("k > 1"), "shared-shingles")
    names = {"a": ("pn", "ppos"), "b": ("n", "pos")}
    chain = shared.where("pid IS NOT NULL AND pid <> id").select(F.col("pid").alias("a"), F.col("id").alias("b"), *(F.col(n).alias(f"{s}{c}") for s, cs in names.items() for n, c in zip(cs, ("n", "pos"))))
    sides = F.array_sort(F.array(F.struct("n", "id", "pos"), F.struct("first.n", "first.id", "first.pos")))
    star = shared.where("k > 2 AND first.id <> id").select(sides.alias("s")).select(*(F.col("s")[i][c].alias(s if c == "id" else f"{s}{c}") for i, s in enumerate("ab") for c in ("id", "n", "pos")))
    pairs = chain.unionByName(star).where(_may_link("a", "b")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("b")).withColumnRenamed("x", "a").distinct()
    sizes = own.select("id", "n", "ranges")
    first = cut(verified(pairs, sizes, docs, key, text), "links")

    label = cut(components(first), "first-components")
    left = shared.where("k > 2").select("h", "k", "id", "n", "pos").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = left.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    left = cut(left.join(mixed, "h", "left_semi"), "mixed-shingles")
    several = own.groupBy("id").count().where("count > 1").select("id")  # texts of one id: no sketch, as each counts
    sorted_h = F.concat(F.array_sort(F.collect_set("h")), F.array_repeat(F.lit(NONE), SKETCH))
    sketches = left.join(several, "id", "left_anti").groupBy("id").agg(F.slice(sorted_h, 1, SKETCH).alias("sketch"))
    left = left.join(sketches, "id", "left").withColumn("sketch", F.coalesce("sketch", F.array_repeat(F.lit(NONE), SKETCH)))
    blocks = F.ceil(F.col("k") / MEETING).cast("int")
    left = left.join(sizes.select("id", "n", "ranges"), ["id", "n"]).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    dealt = left.drop("k", "other").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    more = dealt.mapInPandas(_meet, "a long, b long").where("a <> b").distinct().join(pairs, ["a", "b"], "left_anti")
    second = cut(verified(more, sizes, docs, key, text), "more-links")

    stars = label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second)
    final = cut(components(stars), "components")
    rep = classes.withColumnRenamed("id", "rep")
    named = rep.join(final, rep["rep"] == final["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    linked = sets.where("n > 0").join(named, ["s1", "s2"], "left")
    alone = sets.where("n = 0").select("id", "n", F.col("id").alias("component"))
    out = linked.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")).unionByName(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the least id of their component; rows of a null id stay."""
    later = link(docs, key, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_later")).distinct()
    later = cut(later, "near-duplicates")
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)
    return docs.join(later, docs[key] == later["_later"], "left_anti")
