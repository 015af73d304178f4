"""What an ingest run fetches and how it counts: skips, order, outcomes, completeness, failure kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.shared import shared_dir


def unknown_listings(listed: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Listings whose key and hash aren't stored yet."""
    return listed.join(known.select(*key), key, "left_anti")


def missed(known: DataFrame, observed: DataFrame, runs: DataFrame, source: str, reference: str) -> DataFrame:
    """``source, reference`` of known records that a source's complete run has not listed; sources without one miss nothing."""
    judged = known.join(runs.where(F.col("complete")).select(source).distinct(), source, "left_semi")
    return judged.select(source, reference).join(observed.select(source, reference), [source, reference], "left_anti")


def bucket(url: Column, buckets: int = 7) -> Column:
    """The weekday on which a page is fetched again whatever its date says: from the first 32 bits of its digest."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 8), 16, 10).cast("long") % buckets


def due(url: Column, modified: Column, seen: Column, today: Column, settle: int = 2) -> Column:
    """Whether a page is fetched: without a date or never seen, its date is another than the one ``seen`` last (in either direction),
    a date younger than ``settle`` days, or this weekday's turn."""
    young = F.datediff(today, modified) < settle
    return F.coalesce((modified != seen) | young, F.lit(True)) | (bucket(url) == F.unix_date(today) % 7)


def probed(url: Column, today: Column, percent: int = 2) -> Column:
    """Whether a page that would be skipped is fetched today to see if its date is honest: another ``percent`` of pages each day."""
    return bucket(F.concat_ws("@", url, today.cast("string")), 100) < percent


def merged_counters(counts: DataFrame) -> DataFrame:
    """Counters of the parts of runs added up: ``run_id`` and every other column's sum."""
    return counts.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in counts.columns if c != "run_id"))


def resume_order(listed: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """``pos``: never fetched first, then the longest ago, in the order listed."""
    return listed.join(history, key, "left").orderBy(F.asc_nulls_first("fetched"), "listed")


def positions(rows: DataFrame, order: list, label: str = "positions") -> DataFrame:
    """``rows`` with ``pos``, 1 for the first by ``order``, which must decide every tie.

    Rows are dealt by range and written with their partition; a partition's rows are numbered by themselves
    and the rows of the partitions before it are added, so that no task orders all of them.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    dealt = spark.read.schema(ranged.schema).parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("pos", at).join(F.broadcast(counts), "_part").withColumn("pos", F.col("pos") + F.col("_before")).drop("_part", "_before")


def distrusted(probes: DataFrame, most: float = 0.01) -> DataFrame:
    """Sources whose probes show a changed page under an unchanged date more often than ``most``."""
    per = probes.groupBy("source").agg(F.count("*").alias("probes"), F.count_if("dishonest").alias("dishonest"))
    return per.withColumn("distrusted", F.col("dishonest") > F.col("probes") * most)


def failure_kind(code: Column) -> Column:
    """The kind of a failure by HTTP status."""
    return (
        F.when(code.isin(401, 403), "blocked").when(code.isin(404, 410), "gone").when(code == 429, "rate_limited")
        .when(code.between(500, 599), "server").when(code.between(400, 499), "client").when(code.between(200, 399), None).otherwise("network")
    )


def completeness(aborted: Column, resumed: Column, truncated: Column) -> Column:
    return F.when(aborted, "aborted").when(resumed, "resumed").when(truncated, "truncated").otherwise("complete")


def counters(items: DataFrame) -> DataFrame:
    """Found, new, changed, unchanged and rejected items of each run."""
    kinds = ("new", "changed", "unchanged", "rejected")
    return items.groupBy("run_id").agg(F.count("*").alias("found"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))
