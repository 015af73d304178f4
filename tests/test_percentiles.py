import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import percentiles, runs

SHARES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}


def rows_of(rng, n=3000):
    groups = ["a"] * (n // 2) + [None] * (n // 4) + ["b"] * (n // 4 - 3) + ["c", "c", "d"]
    value = lambda g: None if rng.random() < 0.05 else 5.0 if rng.random() < 0.4 else round(rng.gauss(0, 1) * 10 ** rng.randint(-3, 6), 3)
    return [(g, value(g)) for g in groups] + [("none", None)] * 3


@pytest.mark.parametrize("continuous", [True, False])
def test_equals_the_definition(spark, monkeypatch, continuous):
    rows = rows_of(random.Random(7))
    df = spark.createDataFrame(rows, "g string, v double")
    own = {}
    for g, v in rows:
        if v is not None:
            own.setdefault(g, []).append(v)
    method = "linear" if continuous else "inverted_cdf"
    want = {g: {n: float(np.quantile(vs, s, method=method)) for n, s in SHARES.items()} for g, vs in own.items()}
    monkeypatch.setattr(percentiles, "AT_ONCE", 10)
    for got in (percentiles.exact(df, ["g"], "v", SHARES, continuous), percentiles.by_ranges(df, ["g"], "v", SHARES, continuous, ranges=23)):
        found = {r["g"]: {n: r[n] for n in SHARES} for r in got.collect()}
        assert set(found) == set(want)
        for g in want:
            for n in SHARES:
                assert found[g][n] == pytest.approx(want[g][n], rel=1e-12, abs=1e-9), (g, n)


def test_both_ways_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(random.Random(8)), "g string, v double")
    small = percentiles.exact(df, ["g"], "v", SHARES).orderBy("g").collect()
    monkeypatch.setattr(percentiles, "AT_ONCE", 1)
    large = percentiles.exact(df, ["g"], "v", SHARES).orderBy("g").collect()
    assert [[pytest.approx(x) if isinstance(x, float) else x for x in r] for r in small] == [list(r) for r in large]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles.by_ranges(df, ["g"], "v", SHARES).count() == 0


def test_a_sketch_is_near(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    for r in percentiles.sketched(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect():
        assert abs(r["p50"] / 100_003 - 0.5) < 0.01 and abs(r["p95"] / 100_003 - 0.95) < 0.01


def test_run_statistics_by_ranges(spark, monkeypatch):
    rng = random.Random(9)
    sources = spark.createDataFrame([(f"s{i}",) for i in range(5)], "source string")
    made = [(f"s{rng.randint(0, 3)}", str(i), rng.choice(["succeeded", "failed", "running"]), rng.random() * 100, i) for i in range(500)]
    table = spark.createDataFrame(made, "source string, run_id string, status string, seconds double, found int")
    items = spark.createDataFrame([("s1", "new")], "source string, outcome string")
    small = runs.run_stats(sources, table, items).orderBy("is_total", "source").collect()
    monkeypatch.setattr(percentiles, "AT_ONCE", 1)
    assert runs.run_stats(sources, table, items).orderBy("is_total", "source").collect() == small and len(small) == 6
