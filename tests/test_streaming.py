import datetime
import time

from pyspark.sql import functions as F

from sluice.operators import history
from sluice.streaming import outbox, polls

EVENTS = "sequence long, aggregate long, kind string, status string"


def documents(spark, n, salt=""):
    return spark.createDataFrame([(i, f"h{i}{salt}", "active" if i % 2 else "archive") for i in range(n)], "aggregate long, hash string, partition string")


def state(spark, path):
    return sorted(map(tuple, outbox.current(spark, path).where("NOT deleted").select("aggregate", "hash", "partition").collect()))


def test_coalesce_takes_the_last_event(spark):
    rows = [(1, 1, "upsert", None), (2, 1, "delete", None), (3, 2, "delete", None), (4, 2, "upsert", "closed"), (5, 3, "other", None)]
    got = {r["aggregate"]: (r["sequence"], r["kind"], r["status"], r["n"]) for r in outbox.coalesce(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {1: (2, "delete", None, 2), 2: (4, "upsert", "closed", 2)}


def test_batches_are_idempotent_and_never_go_back(spark, tmp_path):
    path = str(tmp_path / "projection")
    docs = documents(spark, 5)
    first = spark.createDataFrame([(1, 0, "upsert", None), (2, 1, "upsert", None), (3, 2, "upsert", None)], EVENTS)
    outbox.apply_batch(first, 0, docs, path)
    once = state(spark, path)
    outbox.apply_batch(first, 0, docs, path)
    assert state(spark, path) == once and len(once) == 3
    outbox.apply_batch(spark.createDataFrame([(4, 1, "delete", None), (5, 9, "upsert", None)], EVENTS), 1, docs, path)
    assert [r[0] for r in state(spark, path)] == [0, 2]
    outbox.apply_batch(spark.createDataFrame([(2, 1, "upsert", None)], EVENTS), 2, docs, path)
    assert [r[0] for r in state(spark, path)] == [0, 2]  # older than what was applied
    moved = docs.withColumn("partition", F.when(F.col("aggregate") == 0, "active").otherwise(F.col("partition")))
    outbox.apply_batch(spark.createDataFrame([(9, 0, "upsert", None)], EVENTS), 3, moved, path)
    assert state(spark, path)[0] == (0, "h0", "active")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 7 % 10, "delete" if i % 5 == 0 else "upsert", None) for i in range(100)]
    source = str(tmp_path / "log")
    for k in range(4):
        spark.createDataFrame(rows[k * 25 : (k + 1) * 25], EVENTS).coalesce(1).write.mode("append").parquet(source)
    docs = documents(spark, 8)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    outbox.project(stream, docs, str(tmp_path / "streamed"), str(tmp_path / "checkpoint")).awaitTermination()
    outbox.apply_batch(spark.createDataFrame(rows, EVENTS), 0, docs, str(tmp_path / "once"))
    assert state(spark, str(tmp_path / "streamed")) == state(spark, str(tmp_path / "once"))


def test_missed_polls_stream_equals_window(spark, tmp_path):
    rows = [(k, p, (p * k) % 7 == 0, p % 4 != 3) for p in range(40) for k in range(1, 6)]
    schema = "key long, poll long, seen boolean, complete boolean"
    source = str(tmp_path / "polls")
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], schema).coalesce(1).write.parquet(f"{source}/part={k}")
    files = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(source)
    q = polls.missed_polls(files.select("key", "poll", "seen", "complete")).writeStream.format("memory").queryName("missed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = history.missed_polls(spark.createDataFrame(rows, schema), "key", "poll").select("key", "poll", F.col("missed").cast("long"), "status")
    assert sorted(map(tuple, spark.table("missed").collect())) == sorted(map(tuple, want.collect()))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    source = str(tmp_path / "e")
    for k, rows in enumerate([[(at(1),), (at(2),)], [(at(40),)], [(at(42),)], [(at(3),), (at(43),)]]):
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.parquet(f"{source}/part={k}")
        time.sleep(1.1)  # files are taken by age
    events = spark.readStream.schema("ts timestamp, part int").option("maxFilesPerTrigger", 1).parquet(source)
    q = polls.windowed_counts(events, "ts", "10 minutes", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["start"], r["n"]) for r in spark.table("windows").collect()] == [(at(0), 2)]


def test_a_rebuild_equals_its_documents_and_goes_on(spark, tmp_path):
    docs = documents(spark, 6)
    folder = outbox.rebuild(docs, str(tmp_path), "2")
    assert outbox.rebuild(docs, str(tmp_path), "2") == folder
    assert state(spark, folder) == sorted(map(tuple, docs.collect()))
    outbox.apply_batch(spark.createDataFrame([(7, 3, "delete", None)], EVENTS), 0, docs, folder)
    assert [r[0] for r in state(spark, folder)] == [0, 1, 2, 4, 5]


def test_compaction_pointer_and_high_water(spark, tmp_path):
    path, docs = str(tmp_path), documents(spark, 8)
    folder = outbox.rebuild(docs, path, "1", high_water=10)
    outbox.point_to(spark, path, "1")
    outbox.apply_batch(spark.createDataFrame([(9, 3, "delete", None), (12, 4, "delete", None), (13, 5, "close", None)], EVENTS), 0, docs, folder)
    assert outbox.watermark(spark, folder) == 13
    live = state(spark, folder)
    assert [r[0] for r in live] == [0, 1, 2, 3, 5, 6, 7] and (5, "h5", "archive") in live
    into = outbox.compact(spark, outbox.pointed(spark, path), path, "2")
    outbox.point_to(spark, path, "2")
    assert outbox.pointed(spark, path) == into and state(spark, into) == live and outbox.mutations(spark, into).count() == 8
    outbox.apply_batch(spark.createDataFrame([(11, 4, "upsert", None), (14, 4, "upsert", None)], EVENTS), 1, docs, into)
    assert [r[0] for r in state(spark, into)] == list(range(8))


def test_a_batch_reads_the_buckets_of_its_events(spark, tmp_path):
    path = outbox.rebuild(documents(spark, 200), str(tmp_path), "1")
    plan = outbox.mutations(spark, path).where("bucket IN (3, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
