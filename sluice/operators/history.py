"""History of records: versions with validity, arrivals, curation, lifecycle and missed polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Complete runs that must miss a record before it counts as stale.
MISSED = 3


def validity(versions: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """``valid_from, valid_to, current``: a version is valid until the next one begins."""
    w = Window.partitionBy(key).orderBy(order)
    return versions.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(w)}).withColumn("current", F.col("valid_to").isNull())


def arrival(known: DataFrame, arrived: DataFrame, key: list[str]) -> DataFrame:
    """``outcome`` of each arrival against the stored hash: ``new``, ``unchanged`` or ``changed``; ``replayed``, if arrivals say so, wins."""
    stored = known.select(*key, F.col("hash").alias("_hash"), F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("_hash")), "unchanged").otherwise("changed")
    if "replayed" in arrived.columns:
        outcome = F.when(F.coalesce("replayed", F.lit(False)), "replayed").otherwise(outcome)
    return arrived.join(stored, key, "left").withColumn("outcome", outcome).drop("_hash", "_known")


#: Names of the events that curation writes (fixed values).
EVENT_NAMES = {"new": "nieuw", "changed": "gewijzigd", "status_changed": "status_gewijzigd"}


def curation_events(curated: DataFrame, key: str, order: str) -> DataFrame:
    """``aggregate, version, kind, status, id`` of a curation: one event for each version, with an id that a replay repeats."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv)), F.col("event"))
    own = curated.where(F.col("event").isNotNull())
    return own.select(F.col(key).alias("aggregate"), "version", kind.alias("kind"), "status", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(order).cast("string"), kind), 256).alias("id"))


def curated_event(before: Column) -> Column:
    """What an observation (``hash, status``) means behind the one before it, null if there is none."""
    return (
        F.when(before.isNull(), "new")
        .when(~F.col("hash").eqNullSafe(before["hash"]), "changed")
        .when(~F.col("status").eqNullSafe(before["status"]), "status_changed")
    )


def curate(observations: DataFrame, key: str, order: str) -> DataFrame:
    """The curation of a key's observations in order: event and version after each.

    The first one is ``new`` with version 1.  One with another hash is ``changed``: the open version closes and
    the next begins.  One of the same hash but another status is ``status_changed``, also a version; any other
    writes nothing.  An observation of unknown status keeps the status before it.
    """
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known = observations.withColumn("status", F.last("status", ignorenulls=True).over(so_far))
    before = F.lag(F.struct("hash", "status")).over(w)
    told = known.withColumn("event", curated_event(before))
    return told.withColumn("version", F.count("event").over(so_far))


def keep_or_clear(stored: Column, arrived: Column, cleared: Column) -> Column:
    """An absent value keeps what is stored, a cleared one empties it, any other replaces it."""
    return F.when(cleared, None).otherwise(F.coalesce(arrived, stored))


def lifecycle(closed: Column, seen: Column, missed: Column, current: Column) -> Column:
    """Closing signals first, then being seen, then missed polls (a closed record stays closed)."""
    return (
        F.when(closed, "closed")
        .when(seen, "active")
        .when(current == "closed", "closed")
        .when(missed >= MISSED, "stale")
        .otherwise(F.coalesce(current, F.lit("unknown")))
    )


def missed_polls(polls: DataFrame, key: str, run: str) -> DataFrame:
    """``missed, status`` after each poll from ``seen, complete``: complete polls in a row that missed the record.

    Seeing it resets the count, incomplete polls leave it, and it stops one above the threshold.  At the
    threshold the record is stale; seen again, active.
    """
    w = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    spell = polls.withColumn("_spell", F.sum(F.col("seen").cast("int")).over(w))
    own = Window.partitionBy(key, "_spell").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    missed = F.least(F.sum((~F.col("seen") & F.col("complete")).cast("int")).over(own), F.lit(MISSED + 1))
    return spell.withColumn("missed", missed).withColumn("status", F.when(F.col("missed") >= MISSED, "stale").otherwise("active")).drop("_spell")


def abandoned(runs: DataFrame, cutoff: str) -> DataFrame:
    """Running runs that began before the cutoff fail."""
    old = (F.col("status") == "running") & (F.col("started") < F.lit(cutoff).cast("timestamp_ntz"))
    return runs.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def latest_revision(rows: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Last write wins: the row of the highest revision, unless that one is a tombstone (``deleted``)."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(revision)).alias("_row"))
    return last.select(*key, "_row.*").where("NOT deleted")


def write_revisions(stored: DataFrame, writes: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Writes that expect a revision, against what is stored: the rows after them, and ``outcome, revision`` of each write.

    ``stored`` has the key, ``revision``, ``deleted`` and values; ``writes`` the key, ``order``, ``expected`` (null to create),
    ``deleted`` and the same values.  Writes of a key are taken in order: one is ``applied`` if it expects the revision
    that is there then, and makes the next; any other is a ``conflict`` and is told the revision that is there.  A tombstone keeps its
    row and revision, and is only written over by a write that expects that revision.  A key's writes of one call are folded together;
    everything else stays distributed.
    """
    values = [c for c in stored.columns if c not in (*key, "revision")]
    now = stored.select(*key, F.col("revision").alias("_revision"), F.struct(*values).alias("_stored"))
    one = F.struct(F.col(order).alias("order"), F.col("expected").alias("expected"), F.struct(*values).alias("row"))
    turns = writes.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_writes")).join(now, key, "left")
    outcome = "array<struct<order: " + writes.schema[order].dataType.simpleString() + ", outcome: string, revision: long>>"
    row = turns.schema["_stored"].dataType.simpleString()
    start = F.struct(F.col("_revision").cast("long").alias("revision"), F.col("_stored").cast(row).alias("row"), F.array().cast(outcome).alias("told"))

    def step(state: Column, write: Column) -> Column:
        fits = write["expected"].cast("long").eqNullSafe(state["revision"])
        revision = F.when(fits, F.coalesce(state["revision"], F.lit(0).cast("long")) + 1).otherwise(state["revision"])
        told = F.array(F.struct(write["order"].alias("order"), F.when(fits, "applied").otherwise("conflict").alias("outcome"), revision.alias("revision"))).cast(outcome)
        return F.struct(revision.alias("revision"), F.when(fits, write["row"].cast(row)).otherwise(state["row"]).alias("row"), F.concat(state["told"], told).alias("told"))

    folded = turns.select(*key, F.aggregate("_writes", start, step).alias("_end"))
    outcomes = folded.select(*key, F.explode("_end.told").alias("_t")).select(*key, F.col("_t.order").alias(order), "_t.outcome", "_t.revision")
    touched = folded.where("_end.revision IS NOT NULL").select(*key, F.col("_end.revision").alias("revision"), "_end.row.*")
    rest = stored.join(folded.select(*key), key, "left_anti")
    return rest.select(*key, "revision", *values).unionByName(touched.select(*key, "revision", *values)), outcomes
