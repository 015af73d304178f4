import json

import pytest
from pyspark.sql import functions as F

from sluice.sources import paged

OPTIONS = {"records": "data.items", "page": "meta.page", "size": "meta.size", "total": "meta.total"}


def capture(folder, page, records, total=7, size=3, number=None):
    payload = {"data": {"items": records}, "meta": {"page": page if number is None else number, "size": size, "total": total}}
    (folder / f"page-{page}.json").write_text(json.dumps({"capturedAt": f"2024-01-0{page}", "payload": payload}))


def drain(spark, folder, tmp_path, **more):
    stream = spark.readStream.format("pages").options(path=str(folder), **OPTIONS, **more).load()
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("page", "pos", F.get_json_object("record", "$.id").alias("id"), "captured", "total", "short").collect()
    return sorted(map(tuple, rows))


def test_stop_and_resume_give_each_record_once(spark, tmp_path):
    paged.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    capture(folder, 1, [{"id": i} for i in (1, 2, 3)])
    capture(folder, 3, [{"id": 7}])  # behind a gap: not yet
    first = drain(spark, folder, tmp_path)
    assert [r[2] for r in first] == ["1", "2", "3"]
    assert drain(spark, folder, tmp_path) == first
    capture(folder, 2, [{"id": 4}, {"id": 5}])
    capture(folder, 4, [{"id": 99}])  # beyond what the listing says it has
    rows = drain(spark, folder, tmp_path)
    assert [(r[0], r[2], r[5]) for r in rows] == [(1, "1", False), (1, "2", False), (1, "3", False), (2, "4", True), (2, "5", True), (3, "7", False)]
    whole = spark.read.format("pages").options(path=str(folder), **OPTIONS).load()
    assert sorted(map(tuple, whole.select("page", "pos", F.get_json_object("record", "$.id"), "captured", "total", "short").collect())) == rows
    assert whole.rdd.getNumPartitions() == 3


@pytest.mark.parametrize(
    ("numbers", "says"),
    [({"total": -1}, "whole number"), ({"total": 2.5}, "whole number"), ({"total": "7"}, "whole number"), ({"size": 0}, "whole number"), ({"total": 10_000}, "more than 100"), ({"number": 2}, "begins at page 1"), ({"total": True}, "whole number")],
)
def test_invalid_numbers_are_errors(tmp_path, numbers, says):
    capture(tmp_path, 1, [], **numbers)
    with pytest.raises(ValueError, match=says):
        paged.Listing({"path": str(tmp_path), **OPTIONS}).captured()


def test_a_page_that_is_another_is_an_error(spark, tmp_path):
    paged.register(spark)
    capture(tmp_path, 1, [{"id": 1}])
    capture(tmp_path, 2, [{"id": 2}], number=3)
    with pytest.raises(Exception, match="calls itself 3"):
        spark.read.format("pages").options(path=str(tmp_path), **OPTIONS).load().collect()


def test_pointers():
    document = {"a": [{"b": [1, 2]}, {"c": 0}, {"b": [3]}], "e": [], "n": {"m": 5}}
    assert paged.pointed(document, "a[].b[]") == [1, 2, 3] and paged.pointed(document, "e[].x") == [] and paged.pointed(document, "n.m") == [5]
    for wrong in ("a.b", "x", "", "n.", "n.m[]"):
        with pytest.raises(ValueError):
            paged.pointed(document, wrong)
