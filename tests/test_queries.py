"""Every named query gives the rows of its SQL on the small tables."""

import os

import duckdb
import pytest

from sluice.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_its_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    run = oracle.execute(catalogue.ORACLE_SQL[name])
    assert got == canonical([d[0] for d in run.description], run.fetchall())


def test_invariants(spark):
    stats = catalogue.QUERIES["runs_stats_grouping_sets"](spark, SF).collect()
    total = next(r for r in stats if r["is_total"])
    for c in ("runs", "succeeded", "failed", "running", "found", "items", "new_items"):
        assert sum(r[c] for r in stats if not r["is_total"]) == total[c]
    assert total["items"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_pages_join_to_the_whole_order(spark):
    from pyspark.sql import functions as F

    from sluice.operators import search
    from sluice.plans.registry import Tables
    from sluice.plans.search_queries import docs

    rows = docs(Tables(spark, SF))
    for mode in ("newest", "rate-low", "closing-soon"):
        whole = [r["id"] for r in rows.orderBy(*search.ordered(rows, mode)).collect()]
        pages = [r["id"] for o in range(0, 200, 30) for r in search.page(rows, mode, o, 30).collect()]
        assert pages == whole[: len(pages)] and len(pages) == rows.agg(F.count("*")).first()[0]
