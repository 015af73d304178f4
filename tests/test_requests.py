import time

import pytest
from pyspark.sql import functions as F

from sluice.operators import assessment, exporting, history
from sluice.sources import stores


def test_canonical_documents(spark):
    rows = [('{"b": [1, 2.50, {"y": null, "x": "é"}], "a": 1e2}', '{"a":100.0,"b":[1,2.5,{"x":"\\u00e9","y":null}]}'), ('{"a": [1, 2]}', '{"a": [2, 1]}'), ("{broken", None), (None, None), ('{"s": "[1.0, 2.0]", "n": [3.0, -0.5]}', '{"n":[3,-0.5],"s":"[1.0, 2.0]"}'), ('"[1.0]"', '"[1]"')]
    df = spark.createDataFrame(rows, "a string, b string").select(assessment.query_digest(F.col("a")).alias("a"), assessment.query_digest(F.col("b")).alias("b"))
    same = [r["a"] == r["b"] for r in df.collect()]
    assert same == [True, False, True, True, True, False] and df.collect()[2]["a"] is None


def test_two_writers_one_conflict(spark):
    stored = spark.createDataFrame([("k", 3, False, "old"), ("gone", 2, True, "t"), ("other", 1, False, "o")], "key string, revision long, deleted boolean, value string")
    writes = [("k", 1, 3, False, "a"), ("k", 2, 3, False, "b"), ("k", 3, 4, False, "c"), ("gone", 1, None, False, "x"), ("new", 1, None, False, "n"), ("new", 2, None, False, "m"), ("none", 1, 5, False, "q")]
    rows, told = history.write_revisions(stored, spark.createDataFrame(writes, "key string, turn int, expected long, deleted boolean, value string"), ["key"], "turn")
    assert sorted(map(tuple, told.collect())) == [("gone", 1, "conflict", 2), ("k", 1, "applied", 4), ("k", 2, "conflict", 4), ("k", 3, "applied", 5), ("new", 1, "applied", 1), ("new", 2, "conflict", 1), ("none", 1, "conflict", None)]
    assert sorted(map(tuple, rows.collect())) == [("gone", 2, True, "t"), ("k", 5, False, "c"), ("new", 1, False, "n"), ("other", 1, False, "o")]


def test_lost_and_changed_payloads_are_reported(spark):
    source = spark.createDataFrame([(i, f"p{i}") for i in range(500)], "id long, payload string")
    stored = source.where("id <> 17").withColumn("payload", F.when(F.col("id") == 40, "x").otherwise(F.col("payload"))).unionByName(source.where("id = 9")).unionByName(spark.createDataFrame([(999, "e")], "id long, payload string"))
    assert sorted(map(tuple, stores.readback(source, stored, ["id"], ["payload"]).collect())) == [(9, "repeated"), (17, "lost"), (40, "changed"), (999, "extra")]
    assert stores.readback(source, source.orderBy(F.desc("id")), ["id"], ["payload"]).count() == 0
    assert stores.readback(source.limit(0), source.limit(0), ["id"], ["payload"]).count() == 0


def test_a_slow_question_is_cancelled_and_others_go_on(spark):
    slow = "SELECT sum(hash(id)) AS n FROM range(0, 1000000000000, 1, 8)"
    began = time.time()
    answer = exporting.ask(spark, slow, seconds=2)
    assert answer.reason == "timeout" and answer.rows == [] and time.time() - began < 60
    after = exporting.ask(spark, "SELECT id FROM range(10) ORDER BY id", cap=4)
    assert [r["id"] for r in after.rows] == [0, 1, 2, 3] and after.truncated and after.reason is None and after.columns == ["id"]
    assert not exporting.ask(spark, "SELECT id FROM range(4)", cap=4).truncated
    assert not spark.sparkContext.getJobTags()


def test_dry_runs_and_tables(spark):
    spark.range(3).selectExpr("id", "'x' AS name").createOrReplaceTempView("listed")
    assert exporting.tables(spark)["listed"] == [("id", "bigint", True), ("name", "string", True)] or exporting.tables(spark)["listed"][0][:2] == ("id", "bigint")
    plan = exporting.dry_run(spark, "SELECT name FROM listed WHERE id > 1")
    assert plan and "Filter" in "\n".join(plan)
    with pytest.raises(Exception, match="missing"):
        exporting.dry_run(spark, "SELECT missing FROM listed")


def test_status_in_one_pass_is_that_of_the_findings(spark):
    own = spark.createDataFrame([(i, "q", "s", [] if i == 5 else ["a", "b"]) for i in range(8)], "request long, query_digest string, selection_digest string, ids array<string>")
    own = own.withColumn("selection_digest", assessment.selection_digest(own["query_digest"], own["ids"]))
    attested = spark.createDataFrame([(i, "x" if i == 2 else "q", [] if i == 5 else ["b", "a"], "partial" if i == 3 else "complete") for i in range(7)], "request long, query_digest string, ids array<string>, search string")
    claim = "request long, item long, field string, status string, value string, cited array<string>"
    claims = spark.createDataFrame([(i, 1, "f", "known", "v", ["a", "b"]) for i in range(8) if i != 6], claim)
    theirs = spark.createDataFrame([(i, 1, "f", "known", "w" if i == 4 else "v", ["b", "a"]) for i in range(8)] + [(1, 1, "f", "known", "v", ["a", "b"])], claim)
    want = assessment.request_status(own, claims, attested, assessment.request_findings(own, claims, attested, theirs))
    got = assessment.assessed(own, claims, attested, theirs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["status"] for r in got.collect()} == {"passed", "needs-review", "insufficient-evidence", "blocked-upstream"}
