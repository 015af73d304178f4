"""Ranking: nearest vectors, fusion of rankings, and measures of a ranking against judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str) -> DataFrame:
    """``key, similarity``: the ``k`` rows of highest cosine with one query vector, a top-k over one scan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    cosine = dot(v, q) / (F.sqrt(dot(v, v)) * F.lit(sum(x * x for x in query) ** 0.5))
    return vectors.select(key, F.round(cosine, 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def fuse(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``key, rank`` lists: the sum of ``1 / (k + rank)``."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def measures(ranked: DataFrame, judged: DataFrame, depth_recall: int = 20, depth_gain: int = 10) -> DataFrame:
    """``query, recall, ndcg``: recall at one depth and binary nDCG at another, for queries with relevant rows."""
    total = judged.groupBy("query").agg(F.count("*").alias("relevant"))
    hits = ranked.join(judged, ["query", "id"])
    gain = F.when(F.col("rank") <= depth_gain, 1 / F.log2(F.col("rank") + 1))
    per = hits.groupBy("query").agg(F.count_if(F.col("rank") <= depth_recall).alias("found"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(depth_gain)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = total.join(per, "query", "left")
    return out.select("query", F.round(F.coalesce("found", F.lit(0)) / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def rank_by(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
