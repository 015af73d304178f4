import random
import re

import duckdb
import pytest

from sluice.llm import mixing
from sluice.llm.sql import ORACLE_SQL


def water(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = water(sizes)
    got = mixing.mix(odd_documents).collect()
    assert len(got) == len(rows)
    assert {round(x["target"], 6) for x in got} == {round(v, 6) for v in want.values()}
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(odd_documents.repartition(7)).collect()))


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def held_to_water(docs):
    """Sizes, targets and taken words of every row against Python's own count and resharing."""
    rows = {r["doc_id"]: (r["source"], count(r["text"])) for r in docs.select("doc_id", "source", "text").collect()}
    sizes, largest, taken = {}, {}, {}
    for s, n in rows.values():
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = water(sizes)
    got = mixing.mix(docs).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    for r in got:
        source, size = rows[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r["taken"] <= 3 * size and (not size or r["taken"] % size == 0)
        taken[source] = taken.get(source, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_tables_against_resharing(spark, sf):
    held_to_water(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))


def test_capped_sources(spark):
    rng = random.Random(3)
    for case in range(3):
        rows = [(i, " w" * int(2 ** rng.uniform(0, 9)), rng.choices(["a", "b", "c", None], [1, 2 if case else 0, 40, 1])[0]) for i in range(300)]
        held_to_water(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE_SQL["op4_mixing"]).fetchall())


def test_longer_documents_are_likelier(spark):
    df = spark.range(8000).selectExpr("id doc_id", "repeat('w ', IF(id % 2 = 0, 2, 6)) text", "CASE WHEN id % 4 < 2 THEN 'a' ELSE 'b' END source")
    got = mixing.mix(df).where("target < source_size").collect()
    often = lambda n: sum(r["taken"] > 0 for r in got if r["size"] == n) / sum(r["size"] == n for r in got)
    assert len(got) == 4000 and 2.5 < often(6) / often(2) < 3.6


def test_pareto_keeps_inclusion_probability(spark):
    df = spark.range(6000).selectExpr("id doc_id", "'a b' text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END source")
    got = mixing.mix(df).collect()
    for size in {r["source_size"] for r in got}:
        of = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 2


def test_empty(no_documents):
    assert mixing.mix(no_documents).count() == 0
