"""Statistics of ingest runs: totals by source, latest values, failures, rates and time series.

A run has ``source, run_id, status`` (``succeeded``, ``failed``, ``running``), ``started, seconds, found, failure``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import percentiles

ZONE = "Europe/Amsterdam"


def finished(status: Column) -> Column:
    return status != "running"


def run_stats(sources: DataFrame, runs: DataFrame, items: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each source and one, ``is_total`` 1, for all of them, in one pass of grouping sets over the runs.

    ``items`` (``source, outcome``) are counted by source, and the counts added up for the total, before they are joined, so
    that runs don't multiply them; sources without runs stay.  The 95th percentile of seconds is exact and interpolated:
    kept by the aggregate up to ``percentiles.AT_ONCE`` runs, found by ranges beyond it; with ``exact`` off it comes from
    a sketch of bounded size.
    """
    per = items.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("outcome") == "new").alias("new_items"))
    per = sources.join(per, "source", "left").select(F.lit(0).alias("total"), F.col("source").alias("of"), "items", "new_items")
    both = per.unionByName(per.agg(F.sum("items").alias("items"), F.sum("new_items").alias("new_items")).select(F.lit(1).alias("total"), F.lit(None).cast("string").alias("of"), "items", "new_items"))
    large = exact and runs.count() > percentiles.AT_ONCE
    percentile = "percentile(seconds, 0.95)" if exact and not large else "percentile_approx(seconds, 0.95, 10000)"
    counted = sources.sparkSession.sql(
        f"""
        SELECT source, grouping(source) AS is_total, count(run_id) AS runs,
               count_if(status = 'succeeded') AS succeeded, count_if(status = 'failed') AS failed, count_if(status = 'running') AS running,
               coalesce(sum(found), 0) AS found, round({percentile} FILTER (WHERE status <> 'running'), 6) AS p95_seconds
        FROM {{rows}} GROUP BY GROUPING SETS ((source), ())""",
        rows=sources.join(runs, "source", "left"),
    )
    joined = counted.join(both, (F.col("is_total") == F.col("total")) & F.col("source").eqNullSafe(F.col("of")), "left")
    if large:
        done = runs.where(finished(F.col("status"))).join(sources.select("source"), "source", "left_semi")
        both = F.array(F.struct(F.lit(0).alias("t"), F.col("source").alias("s")), F.struct(F.lit(1).alias("t"), F.lit(None).cast("string").alias("s")))
        ranked = percentiles.by_ranges(done.select("seconds", F.explode(both).alias("g")).select("seconds", "g.t", "g.s"), ["t", "s"], "seconds", {"p95": 0.95})
        joined = joined.join(ranked, (F.col("is_total") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left").withColumn("p95_seconds", F.round("p95", 6))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("source", "is_total", "runs", "succeeded", "failed", "running", "found", zero("items"), zero("new_items"), "p95_seconds")


def success_rate(stats: DataFrame) -> DataFrame:
    """Succeeded runs among finished ones; null where none has finished."""
    done = F.col("runs") - F.col("running")
    return stats.withColumn("success_rate", F.when(done > 0, F.round(F.col("succeeded") / done, 6)))


def latest(runs: DataFrame, value: str) -> DataFrame:
    """The value of each source's latest finished run; the run id breaks ties."""
    return runs.where(finished(F.col("status"))).groupBy("source").agg(F.max_by(value, F.struct("started", "run_id")).alias(f"latest_{value}"))


def top_failures(runs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest failures of each source and of all (source null), with counts."""
    counts = runs.sparkSession.sql("SELECT source, failure, grouping(source) AS is_total, count(*) AS n FROM {rows} GROUP BY GROUPING SETS ((source, failure), (failure))", rows=runs.where("failure IS NOT NULL"))
    rank = F.row_number().over(Window.partitionBy("is_total", "source").orderBy(F.desc("n"), "failure"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def buckets(rows: DataFrame, at: str, unit: str, zone: str = ZONE) -> DataFrame:
    """``bucket, n, value``: tumbling buckets of local time, given back as UTC moments."""
    local = F.from_utc_timestamp(F.col(at).cast("timestamp"), zone)
    return rows.groupBy(F.to_utc_timestamp(F.date_trunc(unit, local), zone).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def json_counter(rows: DataFrame, by: str, document: str, name: str) -> DataFrame:
    """The sum of a counter inside JSON documents; what isn't a number counts as nothing."""
    n = F.get_json_object(document, f"$.{name}").try_cast("long")
    return rows.groupBy(by).agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"))


def nearest_rank(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """Percentiles that are values of the rows: the least one at or below which the share of rows lies."""
    return percentiles.exact(rows, [by], value, {f"p{int(s * 100)}": s for s in shares}, continuous=False)


def weekly(rows: DataFrame, at: str) -> DataFrame:
    """``week, n`` for every Monday-based week from the first to the last, 0 where nothing happened."""
    counts = rows.groupBy(F.date_trunc("week", F.col(at).cast("timestamp")).cast("date").alias("week")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a IS NOT NULL")
    weeks = span.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return weeks.join(counts, "week", "left").fillna(0, ["n"])


def histogram(rows: DataFrame, value: str, width: int) -> DataFrame:
    """``bucket, n``: values floored to multiples of ``width``, empty buckets between the first and last included."""
    counts = rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bucket"))
    return every.join(counts, "bucket", "left").fillna(0, ["n"])
