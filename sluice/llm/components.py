"""Connected components of a table of edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, release

#: Steps after which the run is given up: the number needed grows with the logarithm of the longest path.
MOST_STEPS = 60


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: for every end of an edge (``a``, ``b``, longs) the least id of its component.

    Each step links the neighbours of a node to the least of them, larger ones first, then smaller ones;
    the steps end when every node hangs on the least node of its component.  Rows with a null end are no edges, repeated
    rows one edge, and an empty table gives an empty result.  A step is two partially
    aggregated minima and two joins whose hot keys Spark may split; its result is written to the shared
    folder, so the lineage stays short.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_STEPS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        small = large.join(_least(large), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, stars = stars, cut(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        release(last, large)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    own = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)
