"""Captured listings run again through the path of live ones: what a replay would store, and storing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import history
from sluice.sources import listings

COUNTS = ("created", "updated", "unchanged", "rejected")


def outcomes(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """``drafts`` with ``outcome``: ``rejected`` for one without a key, else ``new``, ``changed`` or ``unchanged`` against ``stored``.

    ``stored`` has ``source, ref, hash``, one row for each version with its number in ``version``; the latest counts.  Of
    several drafts of one key in a capture the last in the listing's order counts (``file``, then ``pos``, where the drafts
    have them), the others are ``repeated``.
    """
    latest = stored.groupBy("source", "ref").agg(F.max_by("hash", "version").alias("hash"))
    order = F.struct(*(F.col(c) for c in ("file", "pos") if c in drafts.columns), F.col("hash"))
    last = drafts.where("ref IS NOT NULL").groupBy("source", "ref").agg(F.max(order).alias("_last"))
    marked = drafts.join(last, ["source", "ref"], "left").withColumn("_order", order)
    one = marked.where("_order = _last").dropDuplicates(["source", "ref"])
    seen = history.arrival(latest, one.drop("_order", "_last"), ["source", "ref"])
    rejected = drafts.where("ref IS NULL").withColumn("outcome", F.lit("rejected"))
    return seen.unionByName(rejected.select(*seen.columns))


def summary(judged: DataFrame, captured: DataFrame) -> DataFrame:
    """``source, observed, created, updated, unchanged, rejected, repeated`` of a replay, one row for each source captured."""
    count = lambda kind: F.count_if(F.col("outcome") == kind)
    per = judged.groupBy("source").agg(count("new").alias("created"), count("changed").alias("updated"), count("unchanged").alias("unchanged"), count("rejected").alias("rejected"))
    all_of = captured.groupBy("source").agg(F.count("*").alias("observed"))
    told = all_of.join(per, "source", "left").fillna(0, list(COUNTS))
    return told.select("source", "observed", *COUNTS, (F.col("observed") - sum(F.col(c) for c in COUNTS)).alias("repeated"))


def replay(spark: SparkSession, path: str, site: listings.Site, store: str, dry_run: bool = True) -> DataFrame:
    """The :func:`summary` of the captures at ``path`` as ``site``'s, against the versions in the Parquet folder ``store``.

    Unless ``dry_run``, new and changed drafts are appended to ``store`` as their next version.  What is appended
    follows from what is stored, so the same captures replayed again write nothing.  A folder that doesn't exist yet
    is an empty store.  One replay of a source at a time writes.
    """
    drafts = listings.drafts(listings.records(listings.read(spark, path), site), site, also=("file", "pos"))
    empty = spark.createDataFrame([], "source string, ref string, hash string, version long")
    there = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    stored = spark.read.parquet(store).select("source", "ref", "hash", "version") if exists else empty
    judged = outcomes(drafts, stored)
    told = summary(judged, drafts)
    if dry_run:
        return told
    rows = told.collect()  # one for each source, told before the store changes
    versions = stored.groupBy("source", "ref").agg(F.max("version").alias("_held"))
    fresh = judged.where("outcome IN ('new', 'changed')").join(versions, ["source", "ref"], "left")
    fresh.withColumn("version", F.coalesce("_held", F.lit(0)) + 1).drop("_held", "outcome", "file", "pos").write.mode("append").parquet(store)
    return spark.createDataFrame(rows, told.schema)
