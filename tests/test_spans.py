import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import history, spans


def observed(seed, n=600):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", None, "b", "c"])
    return [(key(), i, rng.choice(["x", "x", "y", None]), rng.choice(["active", "closed", None, None]), rng.random() < 0.15, rng.random() < 0.7) for i in range(n)]


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_spans_change_nothing(spark, width):
    df = spark.createDataFrame(observed(width), "k string, n long, hash string, status string, seen boolean, complete boolean")
    span = F.floor(F.col("n") / width)
    at = df.withColumn("at", F.when(F.col("n") % 11 > 0, F.col("n")))
    same(spans.validity(at, "k", "n", "at", span), history.validity(at, "k", "n", "at"))
    same(spans.curate(df, "k", "n", span), history.curate(df, "k", "n"))
    same(spans.missed_polls(df, "k", "n", span), history.missed_polls(df, "k", "n"))


def test_a_null_span_comes_first_and_no_rows_give_none(spark):
    schema = "k string, n long, hash string, status string, seen boolean, complete boolean"
    df = spark.createDataFrame(observed(3, 80), schema)
    span = F.when(F.col("n") >= 20, F.floor(F.col("n") / 20))
    same(spans.curate(df, "k", "n", span), history.curate(df, "k", "n"))
    same(spans.missed_polls(df, "k", "n", span), history.missed_polls(df, "k", "n"))
    none = spark.createDataFrame([], schema)
    assert spans.curate(none, "k", "n", span).count() == spans.missed_polls(none, "k", "n", span).count() == spans.validity(none, "k", "n", "n", span).count() == 0


def test_no_rows_are_dealt_by_the_key_alone(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("n"), (F.col("id") % 3).alias("hash"), F.lit("active").alias("status"))
    plan = spans.curate(df, "k", "n", F.floor(F.col("n") / 100))._jdf.queryExecution().executedPlan().toString()
    whole = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "hashpartitioning(k#" in line]
    assert whole == []
