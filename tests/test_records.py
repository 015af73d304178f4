"""Rules where a simpler one would give other rows, and plans that prune."""

from datetime import date, datetime, timezone

import duckdb
from pyspark.sql import functions as F

from sluice.operators import health, merging, relations, search, sweeping

NOW = datetime(2024, 7, 1, 12, tzinfo=timezone.utc)


def test_an_active_search_reads_no_archive(spark, tmp_path):
    docs = spark.range(200).selectExpr("id", "IF(id % 3 = 0, 'closed', 'active') status", "CAST(NULL AS TIMESTAMP) closing", "TIMESTAMP '2024-06-30' last_seen")
    search.store(docs, str(tmp_path / "docs"), NOW)
    active = search.scope(spark.read.parquet(str(tmp_path / "docs")), "active")
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "partition" in plan.split("PartitionFilters")[1].split("]")[0]
    read = active.groupBy(F.regexp_extract(F.input_file_name(), "partition=([a-z]+)", 1)).count().collect()
    assert [tuple(r) for r in read] == [("active", 133)]


def test_an_applied_row_comes_before_a_newer_one(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [(1, "g", at(1), True, False), (2, "g", at(2), True, True), (3, "g", at(3), True, False), (4, "g", at(4), False, True), (5, "g", at(2), True, False)]
    df = spark.createDataFrame(rows, "id long, g string, at timestamp, counts boolean, applied boolean")
    got = {r["id"]: r["later_key"] for r in sweeping.dominators(df, ["g"], F.col("counts"), F.col("applied"), "at", "id").collect()}
    assert got == {1: 2, 2: 3, 5: 3}  # the newest run doesn't count, and what is applied but not later doesn't either


def test_a_source_that_falls_silent_altogether_is_told(spark):
    days = [("a", date(2024, 1, d), 10, 3) for d in range(1, 8)] + [("b", date(2024, 1, d), 10, 3) for d in range(1, 9)] + [("c", date(2024, 1, d), 10, 0) for d in range(1, 8)]
    got = health.silent(spark.createDataFrame(days, "source string, day date, found long, activity long")).collect()
    assert [(r["source"], r["day"], r["found"]) for r in got] == [("a", date(2024, 1, 8), 0)]


def test_the_floor_looks_back_seven_days(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    runs = [("old", at(1), 50), ("old", at(20), 0), ("old", at(21), 0), ("old", at(22), 0), ("down", at(18), 9), ("down", at(20), 0), ("down", at(21), 0), ("down", at(22), 0), ("up", at(21), 0), ("up", at(22), 1), ("low", at(20), 2), ("low", at(21), 0), ("low", at(21, 5), 0), ("low", at(22), 0)]
    got = {r["source"]: (r["peak"], r["zeros"], r["verdict"]) for r in health.discovery_floor(spark.createDataFrame(runs, "source string, at timestamp, found long")).collect()}
    assert got == {"old": (0, 3, "no-history"), "down": (9, 3, "breached"), "up": (0, 0, "ok"), "low": (2, 3, "ok")}


def test_a_live_row_is_listed_once(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    chain = spark.createDataFrame([(i, {1: 2, 2: 3}.get(i)) for i in range(10)], "id long, next long")
    assert [(r["pos"], r["k"]) for r in relations.live_lookup(rows, chain, "k", [5, 1, 3, 5, 2, 77]).collect()] == [(0, 5), (1, 3)]


def test_markers_of_one_name_stand_for_all(spark):
    df = spark.createDataFrame([({"tarief_min": "80", "x": "1"}, ["werkvorm"], {"tariefMin": "CLEARED", "werkvorm": "remote", "x": " "})], "stored map<string,string>, marked array<string>, arrived map<string,string>")
    m = df.select(merging.merged(F.col("stored"), F.col("marked"), F.col("arrived")).alias("m")).first()["m"]
    assert m["facts"] == {"tarief_min": "80", "x": "1", "werkvorm": "remote"}
    assert m["marked"] == sorted(["tarief", "tarief_min", "tarief_max", "tarief_eenheid", "tariefMin", "tariefMax", "tariefEenheid"])


def test_halves_of_what_is_found_go_to_the_even_number(spark, tmp_path):
    """A run of value 10 finds 10 / 20, which is 0 as in the SQL."""
    from sluice.plans import catalogue

    rows = [(1, datetime(2024, 1, 3), 30, 10.0), (2, datetime(2024, 1, 4), 30, 30.0), (3, datetime(2024, 1, 5), 30, 50.0), (4, datetime(2024, 1, 6), 30, 10.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["discovery_floor"](spark, str(tmp_path)).collect()
    want = duckdb.connect().execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'").execute(catalogue.ORACLE_SQL["discovery_floor"]).fetchall()
    assert [tuple(r) for r in got] == want


def test_long_keys_are_digested_once(spark, tmp_path):
    """A first line beyond the bound of stored keys has the digest of the whole key, as in the SQL."""
    from sluice.plans import catalogue

    rows = [(1, "Word " * 500 + "\nx", "en"), (2, "word  " * 500, "en"), (3, "a", None), (4, " A\ny", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["dedup_key_groups"](spark, str(tmp_path)).collect()
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(catalogue.ORACLE_SQL["dedup_key_groups"]).fetchall()
    assert len(want) == 2 and sorted(map(tuple, got)) == sorted(want)
