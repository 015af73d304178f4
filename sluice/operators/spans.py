"""The histories of :mod:`sluice.operators.history` for keys of very many rows, split along their order.

A span is an expression that never falls along the order of a key's rows, such as the month of a moment or a block of
sequence numbers.  Rows are dealt by key and span, so a key that holds a third of all rows is dealt to as many tasks as it has
spans.  What one span leaves to the next ones is a row of a few values; only those rows meet by key.  The results are
those of the same functions of :mod:`~sluice.operators.history`, whatever the spans.

``order`` is total within a key and never null.  A null key is a key like any other, and so is a null span, which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sluice.operators.history import MISSED, curated_event

def _dealt(rows: DataFrame, key: str, span: Column) -> DataFrame:
    return rows.withColumn("_part", F.struct(F.col(key).alias("key"), span.alias("span")))  # structs of nulls are equal, so one join finds them


def _inner(order: str) -> WindowSpec:
    return Window.partitionBy("_part").orderBy(order)


def _by_key() -> WindowSpec:
    """Spans of one key in order."""
    return Window.partitionBy("_part.key").orderBy("_part.span")


def _earlier() -> WindowSpec:
    return _by_key().rowsBetween(Window.unboundedPreceding, -1)


def validity(versions: DataFrame, key: str, order: str, at: str, span: Column) -> DataFrame:
    """``valid_from, valid_to, current`` of each version: the last of a span is valid until the first of the next."""
    parts = _dealt(versions, key, span).withColumn("_at", F.struct(F.col(at).alias("at")))
    first = parts.groupBy("_part").agg(F.min_by("_at", order).alias("_first"))
    after = first.select("_part", F.lead("_first").over(_by_key()).alias("_after"))
    following = F.coalesce(F.lead("_at").over(_inner(order)), F.col("_after"))
    told = parts.join(after, "_part").select(*versions.columns, F.col(at).alias("valid_from"), following["at"].alias("valid_to"))
    return told.withColumn("current", F.col("valid_to").isNull())


def curate(observations: DataFrame, key: str, order: str, span: Column) -> DataFrame:
    """Event and version after each observation: a span is told the last hash, the last known status and the number of events before it."""
    inner = _inner(order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    parts = _dealt(observations, key, span)
    at_known = F.when(F.col("status").isNotNull(), F.col(order))
    ends = parts.groupBy("_part").agg(F.max_by(F.struct("hash"), order).alias("_hash"), F.max_by("status", at_known).alias("_status"))
    left = ends.select("_part", F.lag("_hash").over(_by_key()).alias("_hash"), F.last("_status", ignorenulls=True).over(_earlier()).alias("_status"))
    known = parts.join(left, "_part").withColumn("status", F.coalesce(F.last("status", ignorenulls=True).over(so_far), F.col("_status")))
    earlier = F.when(F.col("_hash").isNotNull(), F.struct(F.col("_hash.hash").alias("hash"), F.col("_status").alias("status")))
    told = known.withColumn("_before", F.coalesce(F.lag(F.struct("hash", "status")).over(inner), earlier)).withColumn("event", curated_event(F.col("_before")))
    counts = told.groupBy("_part").agg(F.count("event").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_events"))
    version = F.count("event").over(so_far) + F.col("_events")
    return told.join(counts, "_part").select(*observations.columns, "event", version.alias("version"))


def missed_polls(polls: DataFrame, key: str, run: str, span: Column) -> DataFrame:
    """``missed, status`` after each poll: polls before the first sight in a span go on with the count that the spans before leave."""
    so_far = _inner(run).rowsBetween(Window.unboundedPreceding, 0)
    parts = _dealt(polls, key, span).withColumn("_spell", F.coalesce(F.sum(F.col("seen").cast("int")).over(so_far), F.lit(0)))
    own = Window.partitionBy("_part", "_spell").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.withColumn("_missed", F.sum((~F.col("seen") & F.col("complete")).cast("int")).over(own))
    ends = counted.groupBy("_part").agg(F.max_by(F.struct(F.coalesce("_missed", F.lit(0)).alias("missed"), F.col("_spell").alias("spell")), run).alias("_end"))
    sights = ends.withColumn("_sights", F.sum("_end.spell").over(_by_key().rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("_part.key", "_sights").orderBy("_part.span").rowsBetween(Window.unboundedPreceding, 0)
    running = sights.select("_part", F.sum("_end.missed").over(since).alias("_running"))
    left = running.select("_part", F.coalesce(F.lag("_running").over(_by_key()), F.lit(0)).alias("_carried"))
    missed = F.least(F.col("_missed") + F.when(F.col("_spell") == 0, F.col("_carried")).otherwise(0), F.lit(MISSED + 1)).cast("int")
    told = counted.join(left, "_part").select(*polls.columns, missed.alias("missed"))
    return told.withColumn("status", F.when(F.col("missed") >= MISSED, "stale").otherwise("active"))
