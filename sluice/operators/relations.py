"""Joins and set comparisons: latest siblings, memberships, overlaps of sources, inventories, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps along which a superseded record is followed.
HOPS = 5


def next_sibling(rows: DataFrame, group: list[str], at: str, key: str) -> DataFrame:
    """Each row with the newest later row of its group, if there is one: ``later_key, later_at``.

    A window over the group instead of a join of all its pairs: the newest row of the group is later than
    all others, and for itself there is none.
    """
    whole = Window.partitionBy(*group).orderBy(F.desc(at), F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    newest = F.first(F.struct(F.col(at).alias("at"), F.col(key).alias("key"))).over(whole)
    later = rows.withColumn("_newest", newest)
    return later.where(F.col("_newest.at") > F.col(at)).select(*rows.columns, F.col("_newest.key").alias("later_key"), F.col("_newest.at").alias("later_at"))


def first_of_each(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rank = 1").drop("_rank")


def memberships(direct: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct ``group, source, item`` of two ways of belonging to a group."""
    return direct.unionByName(linked).distinct()


def overlap_groups(members: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` groups of most sources, then items, then least id, that two or more sources share."""
    g = members.groupBy("group").agg(F.countDistinct("source").alias("sources"), F.countDistinct("item").alias("items"))
    top = g.where("sources >= 2").orderBy(F.desc("sources"), F.desc("items"), "group").limit(k)
    # Names are gathered for these k groups only, which their number lets broadcast.
    own = members.select(F.col("group").alias("_of"), "source").join(F.broadcast(top), F.col("_of").eqNullSafe(F.col("group")))
    names = own.groupBy("group", "sources", "items").agg(F.array_sort(F.collect_set("source")).alias("names"))
    return names.orderBy(F.desc("sources"), F.desc("items"), "group")


def overlap_share(members: DataFrame) -> DataFrame:
    """For each source its groups, those it shares with another source, and their share."""
    shared = members.groupBy("group").agg((F.countDistinct("source") >= 2).alias("shared"))
    own = members.select("group", "source").distinct().join(shared, "group")
    out = own.groupBy("source").agg(F.count("*").alias("groups"), F.count_if("shared").alias("shared_groups"))
    return out.withColumn("share", F.round(F.try_divide("shared_groups", "groups"), 6))


def inventory(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys whose rows in the source (``hash, partition``) and in the index differ, with the reasons.

    A key that the index holds more than once is a duplicate, and compared by its least row.
    """
    once = index.groupBy(key).agg(F.min(F.struct("hash", "partition")).alias("_row"), F.count("*").alias("copies"))
    s, i = source.alias("s"), once.select(key, "_row.*", "copies").alias("i")
    joined = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    missing, orphan = F.col(f"i.{key}").isNull(), F.col(f"s.{key}").isNull()
    reasons = F.array_compact(
        F.array(
            F.when(missing, "missing"),
            F.when(orphan, "orphan"),
            F.when(F.col("i.copies") > 1, "duplicate"),
            F.when(~missing & ~orphan & ~F.col("s.hash").eqNullSafe(F.col("i.hash")), "hash drift"),
            F.when(~missing & ~orphan & ~F.col("s.partition").eqNullSafe(F.col("i.partition")), "wrong partition"),
        )
    )
    return joined.select(F.coalesce(f"s.{key}", f"i.{key}").alias(key), F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def follow(chain: DataFrame) -> DataFrame:
    """``id, final, hops`` from ``id, next``: at most ``HOPS`` steps along ``next``, one join a step."""
    out = chain.select("id", F.col("id").alias("final"), F.lit(0).alias("hops"))
    step = chain.where("next IS NOT NULL").select(F.col("id").alias("_at"), F.col("next").alias("_to"))
    for _ in range(HOPS):
        out = out.join(step, out["final"] == step["_at"], "left").select("id", F.coalesce("_to", "final").alias("final"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    return out


def lookup(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the wanted keys in the order asked, each row once, at the first place that asks for it."""
    asked = rows.sparkSession.createDataFrame([(list(dict.fromkeys(wanted)),)], f"w array<{rows.schema[key].dataType.simpleString()}>")
    return asked.select(F.posexplode("w").alias("pos", key)).join(rows, key).orderBy("pos")


def live_lookup(rows: DataFrame, chain: DataFrame, key: str, wanted: list) -> DataFrame:
    """As :func:`lookup`, with superseded keys (``id, next``) followed to the row that lives; it is listed once."""
    asked = lookup(follow(chain), "id", wanted)
    first = asked.groupBy("final").agg(F.min("pos").alias("pos"))
    return first.select("pos", F.col("final").alias(key)).join(rows, key).orderBy("pos")


def same_members(a: Column, b: Column, ordered: bool) -> Column:
    """Two arrays hold the same members, in the same order if asked."""
    return a == b if ordered else F.array_sort(a) == F.array_sort(b)
