"""Exact top-k search by inner product.

Candidates are sorted by descending length over the whole table and cut into blocks; a query meets a block in
a task that holds this block and one block of queries.  The ``SEEDS`` longest vectors give each query a first
k-th best.  Blocks are then met in rounds, each of as many blocks as all rounds before it, and the k-th best
is raised after each, so a round gives few more than k rows for a query.  A block whose longest vector can't reach
the k-th best by ``|q| |c|`` is never sent to the query: queries are blocked by how far down they have to look,
so pairs of blocks are skipped before the shuffle.  A task takes its candidates by descending length.  Both sides are
rotated by the right singular vectors of all vectors (from the d x d matrix of second moments),
which puts most of a product into the first few coordinates; with the lengths of what is left,
Cauchy-Schwarz bounds each product from above:

    q.c  <=  (first coordinates of q) . (first coordinates of c) + |rest of q| |rest of c|

Only products whose bound reaches the query's k-th best so far are computed, in exact integers, and a task
stops when even ``|q| |c|`` of the longest vector left can't reach it.  A bound never drops a tie: ties go to
the smaller id.  Scores and k-th bests are 64-bit integers throughout; only bounds are doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, release
from sluice.shipping import ship

#: Longest vectors that give each query its first k-th best: a table of fixed size.
SEEDS = 1024
#: Vectors in a block of candidates and of queries: at least, at most, and blocks aimed at in between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 4096, 65_536, 24
QUERY_BLOCK = 2048
#: Lengths that tell queries how far down to look: one for each of so many equal shares of the blocks.
LEVELS = 1024
#: The ends of a long, at which components and scores beyond it are held.
MOST = 2**63 - 1
#: Candidates taken at once, and rotated coordinates used for the bound.
STEP, HEAD = 1024, 24
#: Relative slack for the rounding of bounds, far above that of d-term sums of doubles.
SLACK = 1e-9


def scaled(vector: Column, factor: int = 64) -> Column:
    """``floor(factor * x)`` of each component as long, held at the ends of a long; null unless every component is a finite number."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = lambda x: F.when(x >= float(MOST), F.lit(MOST)).when(x <= -float(MOST), F.lit(-MOST)).otherwise(F.floor(x))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, lambda x: held(x * factor)))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.int64).reshape(len(rows), dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first; what reaches the driver are ``dim`` arrays of ``dim`` numbers."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b["v"], dim).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"i": [key[0]], "row": [sum(np.stack(p["row"].to_list()).sum(0) for p in parts)]})

    rows = vectors.select("v").mapInPandas(moments, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").toPandas()
    gram = np.zeros((dim, dim))
    for i, row in zip(rows["i"], rows["row"]):
        gram[i] = row
    return np.linalg.eigh(gram / max(1.0, np.abs(gram).max()))[1][:, ::-1]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer matrices as 64-bit integers, held at the ends of a long.

    In doubles where sums stay below 2^53, in 64-bit integers below 2^63, else in Python's.
    """
    size = lambda m: int(max(m.max(initial=0), -int(m.min(initial=0))))
    most = size(q) * size(c) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < MOST:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, the least of them first; rows are at least k long."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]


def search_block(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, least: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, candidate, score) of each query's k best here, among those that reach ``least``."""
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    order = np.argsort(-np.einsum("ij,ij->i", cf, cf), kind="stable")
    ci, c, cf = ci[order], c[order], cf[order]
    cr, qr = cf @ turn, qf @ turn
    head = min(HEAD, c.shape[1])
    c_len, q_len = np.sqrt((cf * cf).sum(1)), np.sqrt((qf * qf).sum(1))
    c_rest, q_rest = np.sqrt((cr[:, head:] ** 2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    floor = least.astype(np.int64).copy()
    best = np.full((len(q), k), -MOST)
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(c), STEP):
        to = min(at + STEP, len(c))
        slack = SLACK * (q_len * c_len[at] + 1)
        live = np.flatnonzero(q_len * c_len[at] + slack >= floor)  # the block is sorted: c_len[at] is its longest left
        if not len(live):
            break
        bound = qr[live, :head] @ cr[at:to, :head].T + np.outer(q_rest[live], c_rest[at:to]) + slack[live, None]
        may = (bound >= floor[live, None]) | (floor[live, None] == -MOST)
        rows = np.flatnonzero(may.any(1))
        if not len(rows):
            continue
        cols = np.flatnonzero(may.any(0))
        scores = _exact(q[live[rows]], c[at:to][cols])
        keep = may[np.ix_(rows, cols)] & (qi[live[rows], None] != ci[at:to][None, cols])
        a, b = np.nonzero(keep & (scores >= floor[live[rows], None]))
        found, who = scores[a, b], live[rows][a]
        out_q.append(who), out_c.append(ci[at:to][cols][b]), out_s.append(found)
        best[live[rows]] = _kth(np.concatenate([best[live[rows]], np.where(keep, scores, -MOST)], axis=1), k)
        floor = np.maximum(floor, best.min(1))
    if not out_q:
        return np.empty(0, int), np.empty(0, ci.dtype), np.empty(0, np.int64)
    who, ids, scores = np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)
    reach = scores >= floor[who]
    who, ids, scores = who[reach], ids[reach], scores[reach]
    # The k best of each query here, ties to the smaller id; scores are above -2^63, so they can be negated.
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.empty(0, bool)
    rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
    return who[rank < k], ids[rank < k], scores[rank < k]


def top_k(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer products for each row whose id ``every`` divides.

    Components become ``floor(factor * x)``.  Components and scores beyond a long are held at its ends, and scores
    held there tie.  Vectors that are null, or hold null or non-finite components, take no part, nor do rows
    of a null id; vectors of different dimension are never compared; empty vectors score 0 with each other.  A
    query is not compared with rows of its own id; repeated rows of another id appear as often as they are
    there, in one order or the other.  Equal rows of one query id ask once; different vectors of one query id ask
    together, and the k best over all of them are returned.  Queries with fewer than k candidates return all.
    Long vectors cost ``dimension`` squared numbers in the driver and each task.  An empty table gives an empty
    result.  Only the two named columns are read, so other columns may have any name.  There is one plan for each
    different dimension.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = df.select(df[key].cast("long").alias("id"), scaled(df[vector], factor).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    vectors = cut(vectors.select("id", "v", F.size("v").alias("dim"), length.alias("length")), "vectors")
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim, n in sorted(sizes.items()):
        out = out.unionByName(_of_dimension(vectors.where(F.col("dim") == dim).drop("dim"), dim, n, k, every))
    return out


def _in_blocks(rows: DataFrame, blocks: int, by: list, name: str) -> tuple[DataFrame, int]:
    """Rows sorted into at most ``blocks`` blocks by range, written with their block's number, and the number of blocks."""
    ranges = cut(rows.repartitionByRange(max(1, blocks), *by).withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    many = (ranges.agg(F.max("range")).first()[0] or 0) + 1
    blocks = max(1, min(blocks, many))
    return ranges.withColumn(name, F.floor(F.col("range") * blocks / many)).drop("range"), blocks


def _of_dimension(own: DataFrame, dim: int, n: int, k: int, every: int) -> DataFrame:
    spark = own.sparkSession
    turn = rotation(own, dim) if dim else np.empty((0, 0))
    longest = own.orderBy(F.col("length").desc(), "id").limit(SEEDS).select("id", "v").toPandas()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    # A block's number grows as lengths fall; empty blocks leave gaps, which change nothing.
    candidates, c_blocks = _in_blocks(own, -(-n // size), [F.col("length").desc(), "id"], "cb")
    levels = min(LEVELS, c_blocks)
    tops = candidates.groupBy(F.floor(F.col("cb") * levels / c_blocks).cast("int").alias("level")).agg(F.max("length").alias("top")).collect()
    top = np.full(levels, 0.0)
    for r in tops:
        top[r["level"]] = r["top"]
    top = np.maximum.accumulate(top[::-1])[::-1]  # of this level and all below
    shared = spark.sparkContext.broadcast((longest["id"].to_numpy(), _matrix(longest["v"], dim), turn))

    def look_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's first k-th best and the last level that it has to see."""
        si, s, _ = shared.value
        for b in batches:
            if not len(b):
                continue
            scores = _exact(_matrix(b["v"], dim), s)
            scores[b["id"].to_numpy()[:, None] == si[None, :]] = -MOST
            least = _kth(scores, k)[:, 0] if scores.shape[1] >= k else np.full(len(b), -MOST)
            reach = b["length"].to_numpy()[:, None] * top[None, :]
            seen = (reach + SLACK * (reach + 1) >= least[:, None]) | (least[:, None] == -MOST)
            yield b[["id", "v", "length"]].assign(least=least, depth=seen.sum(1))  # tops fall, so these are the first levels

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        qi, ci = left["id"].to_numpy(), right["id"].to_numpy()
        who, ids, scores = search_block(qi, _matrix(left["v"], dim), ci, _matrix(right["v"], dim), left["least"].to_numpy(), shared.value[2], k)
        return pd.DataFrame({"query_id": qi[who], "vec_id": ids, "score": scores})

    asked = own.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).mapInPandas(look_down, "id long, v array<bigint>, length double, least long, depth int")
    queries, _ = _in_blocks(asked, -(-n // (every * QUERY_BLOCK)), [F.col("depth").desc(), "id"], "qb")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    tops = F.array(*map(F.lit, top.tolist()))
    reach = F.col("length") * F.get(tops, F.floor(F.col("cb") * levels / c_blocks).cast("int"))
    best, begin = None, 0
    while begin < c_blocks:
        end = min(c_blocks, max(1, 2 * begin))
        asking = queries
        if best is not None:
            raised = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
            asking = queries.join(raised, "id", "left").withColumn("least", F.greatest("least", F.coalesce("score", F.lit(-MOST)))).drop("score")
        asking = asking.withColumn("cb", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)).cast("array<bigint>")))
        asking = asking.where((F.col("least") == -MOST) | (reach + SLACK * (reach + 1) >= F.col("least")))
        needed = asking.select("cb", F.col("qb").alias("of")).distinct()
        facing = candidates.where(F.col("cb").between(begin, end - 1)).select("id", "v", "cb").join(needed, "cb")
        hits = asking.select("id", "v", "least", "cb", "qb").groupBy("cb", "qb").cogroup(facing.groupBy("cb", "of")).applyInPandas(meet, "query_id long, vec_id long, score long")
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        last, best = best, cut(hits.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        if last is not None:
            release(last)
        begin = end
    return best.select("query_id", "rank", "vec_id", "score")
