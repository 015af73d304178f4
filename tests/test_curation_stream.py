import datetime

import pytest
from pyspark.sql import functions as F

from sluice.operators import history
from sluice.streaming import curation, outbox

OBSERVED = "key long, position long, hash string, status string, at timestamp"
EVENTS = "sequence long, aggregate long, kind string, status string"
START = datetime.datetime(2024, 1, 1)


def observed(position, key, digest, status, minutes=None):
    return (key, position, digest, status, START + datetime.timedelta(minutes=position if minutes is None else minutes))


def put(spark, rows, source, k):
    spark.createDataFrame(rows, OBSERVED).coalesce(1).write.parquet(f"{source}/part={k}")


def drain(spark, source, tmp_path, **options):
    stream = spark.readStream.schema(OBSERVED + ", part int").option("maxFilesPerTrigger", 1).parquet(source)
    query = curation.curate(stream.drop("part"), **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[3]))


def test_stream_in_batches_with_a_restart_equals_the_table(spark, tmp_path):
    rows = [observed(p, p * p % 7, None if p % 11 == 0 else f"h{p % 13 % 3}", [None, "active", "closed"][p % 5 % 3]) for p in range(200)]
    source = str(tmp_path / "in")
    for k in range(2):
        put(spark, rows[k * 50 : (k + 1) * 50], source, k)
    drain(spark, source, tmp_path)
    put(spark, rows[100:150] + rows[90:100], source, 2)  # some come again
    put(spark, rows[150:], source, 3)
    got = drain(spark, source, tmp_path)
    table = history.curate(spark.createDataFrame(rows, OBSERVED), "key", "position").where("event IS NOT NULL")
    want = table.select("key", "position", "event", "version", "status").collect()
    assert got == sorted(map(tuple, want), key=lambda r: (r[0], r[3])) and len(got) > 30


def test_silent_records_become_stale_when_the_watermark_passes(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, [observed(1, 1, "a", "active", 0), observed(2, 2, "a", "active", 0), observed(3, 3, "a", "closed", 0)], source, 0)
    put(spark, [observed(4, 2, "a", "active", 50)], source, 1)
    put(spark, [observed(5, 9, "z", "active", 85)], source, 2)
    put(spark, [observed(6, 9, "z", "active", 86)], source, 3)
    put(spark, [observed(7, 1, "a", "active", 87), observed(8, 9, "z", "active", 88)], source, 4)
    got = drain(spark, source, tmp_path, silence="60 minutes", late="1 minute")
    assert [r[2:] for r in got if r[0] == 1] == [("new", 1, "active"), ("status_changed", 2, "stale"), ("status_changed", 3, "active")]
    assert [r[2:] for r in got if r[0] == 2] == [("new", 1, "active")]
    assert [r[2:] for r in got if r[0] == 3] == [("new", 1, "closed")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"h{i}", "active") for i in range(300)], "aggregate long, hash string, partition string")


def lying(spark, path):
    return sorted(map(tuple, outbox.placed(spark, path).select("aggregate", "sequence", "partition").collect()))


def test_documents_move_between_folders(spark, tmp_path, docs):
    path = str(tmp_path / "placed")
    events = lambda rows: spark.createDataFrame(rows, EVENTS)
    outbox.place_batch(events([(i + 1, i, "upsert", None) for i in range(300)]), docs, path)
    close = events([(1000, 7, "close", None), (1001, 8, "delete", None), (1002, 9, "upsert", "stale")])
    outbox.place_batch(close, docs, path)
    rows = lying(spark, path)
    assert len(rows) == 300 and (7, 1000, "archive") in rows and (8, 1001, "gone") in rows and (9, 1002, "archive") in rows
    outbox.place_batch(close, docs, path)
    assert lying(spark, path) == rows
    outbox.place_batch(events([(1005, 7, "upsert", None), (900, 8, "upsert", None)]), docs, path)
    rows = lying(spark, path)
    assert (7, 1005, "active") in rows and (8, 1001, "gone") in rows and len(rows) == 300
    active = outbox.placed(spark, path).where("partition = 'active' AND bucket = 3")
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "partition" in plan.split("PartitionFilters")[1].split("]")[0] and {f.rsplit("/", 3)[1:3] == ["partition=active", "bucket=3"] for (f,) in active.select(F.input_file_name()).collect()} == {True}


def test_only_touched_folders_are_written(spark, tmp_path, docs):
    path = tmp_path / "placed"
    outbox.place_batch(spark.createDataFrame([(i + 1, i, "upsert", None) for i in range(300)], EVENTS), docs, str(path))
    files = lambda: {str(f.relative_to(path)) for f in path.rglob("*.parquet")}
    before = files()
    outbox.place_batch(spark.createDataFrame([(1000, 7, "close", None)], EVENTS), docs, str(path))
    changed = {f.rsplit("/", 1)[0] for f in before ^ files()}
    number = docs.where("aggregate = 7").select(outbox.bucket(F.col("aggregate"))).first()[0]
    assert changed == {f"partition=active/bucket={number}", f"partition=archive/bucket={number}"}


def test_a_move_cut_short_is_finished_by_the_next_try(spark, tmp_path, docs):
    path = str(tmp_path / "placed")
    outbox.place_batch(spark.createDataFrame([(1, 7, "upsert", None), (2, 8, "upsert", None)], EVENTS), docs, path)
    cut_short = spark.createDataFrame([(7, 1000, "h7", "archive")], "aggregate long, sequence long, hash string, partition string")
    outbox._overwrite(cut_short.withColumn("bucket", outbox.bucket(F.col("aggregate"))), path)  # it has entered, and not left
    assert len([r for r in lying(spark, path) if r[0] == 7]) == 2
    outbox.place_batch(spark.createDataFrame([(1000, 7, "close", None)], EVENTS), docs, path)
    assert lying(spark, path) == [(7, 1000, "archive"), (8, 2, "active")]


def test_placed_stream_equals_the_log(spark, tmp_path, docs):
    rows = [(i, i * 7 % 40, ["upsert", "close", "delete", "upsert"][i % 4], None) for i in range(1, 120)]
    source = str(tmp_path / "log")
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : (k + 1) * 30], EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    outbox.project_placed(stream(), docs, str(tmp_path / "placed"), str(tmp_path / "c1")).awaitTermination()
    outbox.project(stream(), docs, str(tmp_path / "logged"), str(tmp_path / "c2"), fold_every=2).awaitTermination()
    want = sorted(map(tuple, outbox.current(spark, str(tmp_path / "logged")).where("NOT deleted").select("aggregate", "sequence", "partition").collect()))
    assert [r for r in lying(spark, str(tmp_path / "placed")) if r[2] != "gone"] == want and want
    assert {r["batch"] for r in outbox.mutations(spark, str(tmp_path / "logged")).select("batch").distinct().collect()} == {-3, 2, 3}
