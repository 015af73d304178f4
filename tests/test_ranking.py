"""Positions and fused rankings cover the whole table."""

import random

from pyspark.sql import functions as F

from sluice.operators import fetching
from sluice.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_page_has_its_position(spark):
    got = [r["pos"] for r in catalogue.QUERIES["fetch_resume_order"](spark, SF).collect()]
    assert sorted(got) == list(range(1, spark.read.parquet(f"{SF}/pages.parquet").count() + 1)) and len(got) > 20


def test_positions_over_several_partitions(spark):
    keys = random.Random(3).sample(range(10000), 500)
    rows = [(k, None if k % 3 == 0 else k % 11) for k in keys]
    df = spark.createDataFrame(rows, "id long, fetched int").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = fetching.positions(df, [F.asc_nulls_first("fetched"), F.asc("id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r["id"], r["fetched"]) for r in sorted(got, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in got) == list(range(1, 501))


def test_fusion_takes_both_rankings_from_all_vectors(spark):
    from sluice.operators import ranking
    from sluice.plans.change_queries import OTHER_VECTOR, QUERY_VECTOR

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = [{r["vec_id"] for r in ranking.nearest(vectors, q, 15, "vec_id", "embedding").collect()} for q in (QUERY_VECTOR, OTHER_VECTOR)]
    got = {r["vec_id"] for r in catalogue.QUERIES["rrf_fusion"](spark, SF).collect()}
    assert got == near[0] | near[1] and near[0] != near[1]
