"""What an operator sees of their own work: recent activity, capabilities they hold, and what they have selected.

Requests of many operators are answered in one job.  Activity is ranked by actor and scope before rows are shuffled, so an
actor of very many events sends ten from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name and version of the contract (fixed values).
CONTRACT, VERSION = "operator-context", "1.0.0"
#: Actions that are shown, with what they are done to (fixed values).
SHOWN = {"approve_snapshot": "query_snapshot", "commit_export": "export", "markeer_aanvraag": "aanvraag"}
#: Events of an actor that are looked at, before those that aren't shown are left out.
RECENT = 10


def recent_activity(audit: DataFrame, k: int = RECENT) -> DataFrame:
    """``actor, scope, activity``: the shown ones among an actor's ``k`` newest events of a scope (``id, actor, scope, action, class, at``), newest first.

    The last ``k`` are taken first, so fewer than ``k`` may be shown.  Ties of ``at`` are broken by the higher id.
    """
    newest = Window.partitionBy("actor", "scope").orderBy(F.desc("at"), F.desc("id"))
    last = audit.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k)
    entity = F.element_at(F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv)), F.col("action"))
    shown = last.where(F.col("action").isin(*SHOWN)).select("actor", "scope", F.struct("_rank", "action", F.col("class"), "at", entity.alias("entity")).alias("_e"))
    listed = shown.groupBy("actor", "scope").agg(F.array_sort(F.collect_list("_e")).alias("_es"))  # k at most
    return listed.select("actor", "scope", F.transform("_es", lambda e: F.struct(e["action"].alias("action"), e["class"].alias("class"), e["at"].alias("at"), e["entity"].alias("entity"))).alias("activity"))


def authorised(granted: DataFrame, capabilities: DataFrame, unavailable: DataFrame | None = None) -> DataFrame:
    """``actor, capabilities``: those (``id, effect, outcome, permission``) whose permission an actor is granted (``actor, permission``), by id.

    ``availability`` is ``unknown`` unless the ids that aren't available are given.
    """
    held = granted.distinct().join(capabilities, "permission")
    if unavailable is None:
        held = held.withColumn("availability", F.lit("unknown"))
    else:
        off = unavailable.select("id").distinct().withColumn("_off", F.lit(True))
        held = held.join(off, "id", "left").withColumn("availability", F.when(F.col("_off"), "unavailable").otherwise("available"))
    return held.groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("id", "availability", "effect", "outcome"))).alias("capabilities"))  # as many as the registry has


def _owned(requests: DataFrame, stored: DataFrame, wanted: str) -> DataFrame:
    """The stored row (``id, actor, scope, at``) that a request names, if it is the actor's own in that scope: ``_<wanted>``, when it was last written."""
    own = stored.select(F.col("id").alias(wanted), "actor", "scope", F.struct("at").alias(f"_{wanted}"))
    return requests.join(own, [wanted, "actor", "scope"], "left")


def digest(content: Column) -> Column:
    """SHA-256 of a structure as JSON, its fields as they stand and nulls written out."""
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def operator_context(requests: DataFrame, audit: DataFrame, searches: DataFrame, snapshots: DataFrame, held: DataFrame) -> DataFrame:
    """One row for each request (``request, actor, scope, search, snapshot``) with an ``error`` or the context.

    A search or snapshot that isn't the actor's own in that scope is an error, the search first; one that isn't named is
    ``not_applicable``.  ``digest`` is of what stays the same when nothing has happened in between; ``observed`` is when the newest shown activity was.
    ``held`` is what :func:`authorised` gives.
    """
    found = _owned(_owned(requests, searches, "search"), snapshots, "snapshot")
    lost = lambda name: F.col(name).isNotNull() & F.col(f"_{name}").isNull()
    state = lambda name: F.when(F.col(name).isNull(), "not_applicable").otherwise("present")
    joined = found.join(recent_activity(audit), ["actor", "scope"], "left").join(held, "actor", "left")
    types = {f.name: f.dataType for f in joined.schema.fields}
    none = lambda name: F.coalesce(F.col(name), F.array().cast(types[name]))
    told = joined.withColumns({"activity": none("activity"), "capabilities": none("capabilities"), "error": F.when(lost("search"), "search_not_found").when(lost("snapshot"), "snapshot_not_found")})
    content = F.struct(
        F.lit(CONTRACT).alias("name"), F.lit(VERSION).alias("version"), "actor", "scope", "activity", "capabilities",
        F.struct(F.col("search").alias("id"), state("search").alias("state"), F.col("_search.at").alias("at")).alias("search"),
        F.struct(F.col("snapshot").alias("id"), state("snapshot").alias("state"), F.col("_snapshot.at").alias("at")).alias("snapshot"),
    )
    ok = lambda value: F.when(F.col("error").isNull(), value)
    return told.select(
        "request", "error", ok(F.col("activity")).alias("activity"), ok(F.col("capabilities")).alias("capabilities"), ok(state("search")).alias("search_state"),
        ok(state("snapshot")).alias("snapshot_state"), ok(F.get(F.col("activity"), F.lit(0))["at"]).alias("observed"), ok(digest(content)).alias("digest"),
    )
