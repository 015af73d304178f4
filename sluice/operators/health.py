"""Health of sources: silence, discovery floor, activity, signals and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def daily(events: DataFrame, source: str, at: str) -> DataFrame:
    """``source, day, n``."""
    return events.groupBy(F.col(source).alias("source"), F.col(at).cast("date").alias("day")).agg(F.count("*").alias("n"))


def baseline(days: DataFrame, span: int = 7) -> DataFrame:
    """``baseline``: the mean of a source's counts in the ``span`` days before each day; null without any."""
    w = Window.partitionBy("source").orderBy(F.unix_date("day")).rangeBetween(-span, -1)
    return days.withColumn("baseline", F.round(F.avg("n").over(w), 6))


def every_day(days: DataFrame, measures: list[str]) -> DataFrame:
    """``source, day`` and measures for each day from a source's first to the last of all, 0 where it has no row.

    One row for each source and day, made from two dates a source; the last day of all is one value.
    """
    last = days.agg(F.max("day")).scalar()
    dates = days.groupBy("source").agg(F.min("day").alias("a")).select("source", F.explode(F.sequence("a", last)).alias("day"))
    return dates.join(days.select("source", "day", *measures), ["source", "day"], "left").fillna(0, measures)


def silent(days: DataFrame, share: float = 0.5, span: int = 7) -> DataFrame:
    """``source, day, found, found_before, activity_before`` of days on which a source that answers has fallen silent.

    ``days`` has ``source, day, found, activity`` (new and changed items).  A day counts when nothing is new or changed and
    both what is found and the activity are at most ``share`` of their means over the ``span`` days before, which must be
    above 0.  Days without a row are days on which nothing was found.
    """
    w = Window.partitionBy("source").orderBy(F.unix_date("day")).rangeBetween(-span, -1)
    full = every_day(days, ["found", "activity"])
    told = full.withColumns({"found_before": F.round(F.avg("found").over(w), 6), "activity_before": F.round(F.avg("activity").over(w), 6)})
    drop = (F.col("activity") == 0) & (F.col("found_before") > 0) & (F.col("activity_before") > 0) & (F.col("found") <= F.col("found_before") * share)
    return told.where(drop).select("source", "day", "found", "found_before", "activity_before")


def discovery_floor(runs: DataFrame, peak: int = 5, zeros: int = 3, days: int = 7) -> DataFrame:
    """``source, peak, zeros, verdict`` of each source's latest run (``source, at, found``; ``at`` a timestamp).

    A latest run that finds something is ``ok``.  Else the runs of the ``days`` before it are looked at: without one that
    found something there is ``no-history``; with a peak of ``peak`` or more, ``zeros`` empty runs in a row, the latest
    included, breach the floor.
    """
    whole = Window.partitionBy("source")
    at = F.unix_micros(F.col("at").cast("timestamp"))
    told = runs.select("source", "found", at.alias("at")).withColumn("last", F.max(F.struct("at", "found")).over(whole))
    earlier = (F.col("at") < F.col("last.at")) & (F.col("at") >= F.col("last.at") - days * DAY)
    filled = F.max(F.when(earlier & (F.col("found") > 0), F.col("at"))).over(whole)
    told = told.withColumn("filled", filled)
    per = told.groupBy("source").agg(
        F.max("last.found").alias("now"),
        F.coalesce(F.max(F.when(earlier, F.col("found"))), F.lit(0)).alias("peak"),
        (F.count_if(earlier & (F.col("at") > F.coalesce("filled", F.lit(0)))) + 1).alias("zeros"),
    )
    verdict = F.when(F.col("now") > 0, "ok").when(F.col("peak") <= 0, "no-history").when((F.col("peak") >= peak) & (F.col("zeros") >= zeros), "breached").otherwise("ok")
    return per.select("source", "peak", F.when(F.col("now") > 0, 0).otherwise(F.col("zeros")).cast("long").alias("zeros"), verdict.alias("verdict"))


def last_runs(runs: DataFrame, test: Column, k: int = 3) -> DataFrame:
    """Sources whose last ``k`` runs, at least that many, all pass a test."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at")))
    return runs.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy("source").agg(F.bool_and(test).alias("all"), F.count("*").alias("n")).where(F.col("all") & (F.col("n") == k)).select("source")


def signals(rules: list[tuple[str, str | Column, Column]]) -> Column:
    """The codes and levels of all rules that hold, as an array."""
    grade = lambda level: F.lit(level) if isinstance(level, str) else level
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), grade(level).alias("level"))) for code, level, test in rules)))


def verdict(found: Column, active: Column) -> Column:
    """The worst level among signals; sources that aren't active are not judged."""
    has = lambda level: F.exists(found, lambda s: s["level"] == level)
    return F.when(~active, "inactive").when(has("critical"), "critical").when(has("warning"), "warning").otherwise("healthy")


def new_alerts(raised: DataFrame, open_alerts: DataFrame, key: list[str]) -> DataFrame:
    """Alerts that aren't open yet."""
    return raised.join(open_alerts.select(*key).distinct(), key, "left_anti")


#: Seconds that a schedule may be late, and failures in a day from which they are critical (fixed values).
GRACE, MANY_FAILURES = 300, 3


def source_signals(now: Column) -> Column:
    """The nine signals of a source, from its row.

    The row has ``active, last_run_at, last_status, circuit, scheduler_stale, next_run_at, failed_24h, failure_code,
    silence_open, quiet`` (the last three runs found nothing new); a source that isn't active has one signal only.
    """
    severe = lambda test: F.when(test, "critical").otherwise("warning")
    open_circuit = F.coalesce(F.col("circuit") != "closed", F.lit(False))
    late = F.unix_timestamp("next_run_at") + GRACE <= F.unix_timestamp(now)
    codes = [  # fixed values: codes and levels
        ("never_run", "warning", F.col("last_run_at").isNull()),
        ("circuit_open", "critical", open_circuit),
        ("scheduler_stale", "critical", F.col("scheduler_stale")),
        ("schedule_overdue", severe(open_circuit), late),
        ("recent_failures", severe(F.col("failed_24h") >= MANY_FAILURES), F.col("failed_24h") > 0),
        ("latest_error", severe(F.coalesce(F.col("last_status") == "failed", F.lit(False))), F.col("failure_code").isNotNull()),
        ("silence_open", "warning", F.col("silence_open")),
        ("zero_activity", "info", F.col("quiet")),
    ]
    return F.when(F.col("active"), signals(codes)).otherwise(signals([("inactive", "info", F.lit(True))]))


def to_escalate(alerts: DataFrame, delivered: DataFrame, now: Column, after_seconds: int) -> DataFrame:
    """Open alerts of that age that haven't been escalated: ``id``, oldest first."""
    old = alerts.where(F.col("open") & (F.unix_timestamp(now) - F.unix_timestamp("created") >= after_seconds))
    return old.join(delivered.select("id"), "id", "left_anti").orderBy("created", "id").select("id")
