"""The weekly volume counts every row, and weeks without any."""

from datetime import date, datetime

from sluice.operators import runs
from sluice.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_event_is_counted(spark):
    n = sum(r["n"] for r in catalogue.QUERIES["weekly_volume_zero_filled"](spark, SF).collect())
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()


def test_empty_weeks_are_zero(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 7, 23)), (2, datetime(2024, 1, 8)), (3, datetime(2024, 1, 9)), (4, datetime(2024, 1, 30))], "event_id long, ts timestamp")
    got = sorted(map(tuple, runs.weekly(rows, "ts").collect()))
    assert got == [(date(2024, 1, 1), 1), (date(2024, 1, 8), 2), (date(2024, 1, 15), 0), (date(2024, 1, 22), 0), (date(2024, 1, 29), 1)]
