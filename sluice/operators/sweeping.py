"""Sweeps over observations, projections and change logs: what is dominated, expired, prunable or next."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most observations that one sweep closes, and most documents that one expiry sweep moves.
DOMINATED, EXPIRED = 5000, 2000
#: Named windows that end now, in hours (fixed values).
WINDOWS = {"24u": 24, "7d": 7 * 24, "30d": 30 * 24}


def dominators(rows: DataFrame, group: list[str], counts: Column, applied: Column, at: str, key: str) -> DataFrame:
    """Each row with the row that makes it redundant: ``later_key, later_at``; rows without one are left out.

    Among rows of the group that ``counts`` admits and that began strictly later, applied ones come first, then the newest,
    then the highest key.  A running maximum over falling times takes the place of a join of all pairs: the frame of a
    row is what began later.
    """
    began = F.unix_micros(F.col(at).cast("timestamp"))
    later = Window.partitionBy(*group).orderBy(F.col("_began").desc()).rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(counts, F.struct(applied.alias("applied"), F.col(at).alias("at"), F.col(key).alias("key")))).over(later)
    found = rows.withColumn("_began", began).withColumn("_best", best).where("_best IS NOT NULL")
    return found.select(*rows.columns, F.col("_best.key").alias("later_key"), F.col("_best.at").alias("later_at"))


def next_dominated(found: DataFrame, key: str, most: int = DOMINATED) -> DataFrame:
    """The rows of least key that one sweep takes."""
    return found.orderBy(key).limit(most)


ORDER = ("started", "observed", "run", "hash", "ref")


def disposition(candidate: Column, current: Column, pending: Column) -> Column:
    """What recovery does with an observation, given the pointer that is stored (null for none) and its ``phase``.

    Observations are in the total order of ``ORDER``.  A pending one that says nothing new is done; one that is behind is
    superseded; a pending one at the very place of another can't be ordered.  A lifecycle step of the same run is no proof.
    """
    place = lambda s: F.struct(*(s[c] for c in ORDER))
    same = lambda *cs: F.array_max(F.array(*(~candidate[c].eqNullSafe(current[c]) for c in cs))) == F.lit(False)
    behind, level = place(candidate) < place(current), place(candidate) == place(current)
    by_place = F.when(behind, "superseded").when(level & pending, "blocked_ordering").otherwise("process")
    nothing_new = (
        F.when(same("run", "hash", "ref") & (current["phase"] == "observation"), "already_committed")
        .when(same("hash") & (behind | level), "unchanged")
    )
    free = current.isNull() | (same("run") & (current["phase"] == "lifecycle"))
    return F.when(free, "process").when(current["phase"] == "ambiguous", "blocked_ordering").otherwise(F.coalesce(F.when(pending, nothing_new), by_place))


def expired(documents: DataFrame, pending: DataFrame, key: str, now: datetime, most: int = EXPIRED) -> DataFrame:
    """Live documents of the active partition whose deadline has passed and that no event waits for, by key."""
    passed = F.col("closing") < F.lit(now)
    live = documents.where((F.col("partition") == "active") & F.col("superseded_by").isNull() & passed)
    return live.join(pending.select(key), key, "left_anti").orderBy(key).limit(most).select(key)


def retained(events: DataFrame, now: datetime, days: int) -> DataFrame:
    """The events that stay: those not processed, and those processed within the last ``days``."""
    cutoff = F.lit(now - timedelta(days=days))
    return events.where(F.col("processed").isNull() | (F.col("processed") >= cutoff))


def oldest_first(rows: DataFrame, key: str, created: str, n: int) -> DataFrame:
    """The ``n`` keys whose first row is oldest, ties by key: what has waited longest is tried first."""
    return rows.groupBy(key).agg(F.min(created).alias("first_created")).orderBy("first_created", key).limit(n)


def within(at: Column, window: str, now: datetime) -> Column:
    """A moment is inside a named window that ends now."""
    return at >= F.lit(now - timedelta(hours=WINDOWS[window]))


def by_windows(rows: DataFrame, at: str, by: str, now: datetime) -> DataFrame:
    """``by`` and the number of rows in each named window, in one pass."""
    return rows.groupBy(by).agg(*(F.count_if(within(F.col(at), w, now)).alias(f"in_{w}") for w in WINDOWS))


def poll_since(now: Column, days: int = 1, zone: str = "Europe/Amsterdam") -> Column:
    """The local date from which a poll looks back."""
    return F.to_date(F.from_utc_timestamp(now - F.expr(f"interval {days * 24} hours"), zone))
