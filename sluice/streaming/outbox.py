"""Incremental projection of a change log: coalescing, planning, applying, with Structured Streaming around it.

An event has ``sequence, aggregate, kind`` (``upsert``, ``close``, ``delete`` or another aggregate's), ``status``.  The
projection is kept as batches of mutations under one folder, dealt to ``BUCKETS`` by aggregate; the row of the highest
sequence is the current one.  A batch writes only what it touched, under its own number, so that a batch that runs
twice overwrites itself, and readers see whole batches; it reads only the buckets that its events fall in.  What older
batches have left behind goes when a generation is compacted into the next one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "aggregate long, sequence long, hash string, partition string, deleted boolean, batch long, bucket int"
BUCKETS = 64


def _make(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucket(aggregate: Column) -> Column:
    return F.pmod(F.xxhash64(aggregate), F.lit(BUCKETS)).cast("int").alias("bucket")


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """All mutations of a generation; batch and bucket are folders, so conditions on them prune files."""
    return spark.read.schema(STATE).parquet(path)


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch of mutations (``aggregate, sequence, hash, partition, deleted``) in place of what it wrote before.

    Rows are brought together by bucket, large buckets in parts, so that the number of files doesn't grow with that of tasks.
    """
    dealt = rows.select("aggregate", "sequence", "hash", "partition", "deleted", bucket(F.col("aggregate"))).hint("rebalance", F.col("bucket"))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def coalesce(events: DataFrame) -> DataFrame:
    """``aggregate, sequence, kind, status, n``: the last event of each aggregate in a batch; other kinds are left out."""
    own = events.where(F.col("kind").isin("upsert", "close", "delete"))
    return own.groupBy("aggregate").agg(F.max("sequence").alias("sequence"), F.max_by("kind", "sequence").alias("kind"), F.max_by("status", "sequence").alias("status"), F.count("*").alias("n"))


def effective_partition(kind: Column, status: Column, stored: Column) -> Column:
    """The partition of a document under an event: a status that it carries counts before the stored one, and closing implies closed."""
    said = F.coalesce(status, F.when(kind == "close", "closed"))
    return F.when(said.isin("closed", "stale") & stored.isNotNull(), "archive").otherwise(stored)


def plan(coalesced: DataFrame, state: DataFrame, documents: DataFrame) -> DataFrame:
    """What to do for each aggregate, checked in this order: ``superseded``, ``delete``, ``missing``, ``unchanged``, ``upsert``.

    ``state`` is the current projection (``aggregate, sequence, hash, partition``), ``documents`` what can be loaded
    (``aggregate, hash, partition``); an event's status moves its document (see :func:`effective_partition`).  ``previous`` is the partition that an upsert leaves behind.
    """
    old = state.select("aggregate", F.col("sequence").alias("applied"), F.col("hash").alias("old_hash"), F.col("partition").alias("old_partition"))
    joined = coalesced.join(old, "aggregate", "left").join(documents.select("aggregate", "hash", "partition"), "aggregate", "left")
    joined = joined.withColumn("partition", effective_partition(F.col("kind"), F.col("status"), F.col("partition")))
    action = (
        F.when(F.coalesce(F.col("applied") >= F.col("sequence"), F.lit(False)), "superseded")
        .when(F.col("kind") == "delete", "delete")
        .when(F.col("hash").isNull(), "missing")
        .when((F.col("hash") == F.col("old_hash")) & (F.col("partition") == F.col("old_partition")), "unchanged")
        .otherwise("upsert")
    )
    moved = (action == "upsert") & (F.col("old_partition") != F.col("partition"))
    return joined.select("aggregate", "sequence", action.alias("action"), "hash", "partition", F.when(moved, F.col("old_partition")).alias("previous"))


def lag(events: DataFrame, processed: DataFrame, now: str) -> DataFrame:
    """``waiting, oldest_seconds``: events not yet processed, by id and not by place, so that late commits count."""
    waiting = events.join(processed.select("sequence"), "sequence", "left_anti")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.min(F.unix_timestamp(F.col("at").cast("timestamp")))
    return waiting.agg(F.count("*").alias("waiting"), age.alias("oldest_seconds"))


def repairs(differing: DataFrame, source: DataFrame) -> DataFrame:
    """``aggregate, action, hash, partition``: what makes the projection equal its source again, from the aggregates that differ."""
    gone = F.col("hash").isNull() & F.col("partition").isNull()
    joined = differing.select("aggregate").join(source.select("aggregate", "hash", "partition"), "aggregate", "left")
    return joined.select("aggregate", F.when(gone, "delete").otherwise("upsert").alias("action"), "hash", "partition")


def repair_counts(todo: DataFrame) -> DataFrame:
    """``action, n``: what a repair would do, without doing it."""
    return todo.groupBy("action").agg(F.count("*").alias("n"))


def rebuild_event_id(generation: str, aggregate: Column) -> Column:
    """The id of an aggregate's event in a rebuild, in the form of a UUID of version 5: the same in every try, so replays meet."""
    h = F.sha2(F.concat(F.lit(generation + ":"), aggregate.cast("string")), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def rebuild(documents: DataFrame, path: str, generation: str, high_water: int = 0) -> str:
    """A new generation of the projection in a folder of its own, ready for :func:`current`; returns that folder.

    Readers turn to it when it is whole (:func:`point_to`).  Events up to ``high_water`` are in the documents already and
    are superseded; later ones are replayed on top.  A rebuild that runs again overwrites itself; rows of the old
    generation stay.
    """
    folder = f"{path}/generation={generation}"
    put(documents.select("aggregate", F.lit(high_water).cast("long").alias("sequence"), "hash", "partition", F.lit(False).alias("deleted")), folder, -1)
    return folder


def compact(spark: SparkSession, folder: str, path: str, generation: str) -> str:
    """The last mutation of each aggregate, deletions as well, as a new generation: what it costs to read no longer grows with history."""
    into = f"{path}/generation={generation}"
    put(_last(mutations(spark, folder)), into, -1)
    return into


POINTER = "generation string, turn long"


def _turns(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path}/pointer"
    _make(spark, folder)
    return spark.read.schema(POINTER).parquet(folder)


def point_to(spark: SparkSession, path: str, generation: str) -> None:
    """Make a whole generation the one that readers use; turns are counted, so no clock decides which is the last."""
    last = _turns(spark, path).agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
    spark.createDataFrame([(generation, last + 1)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def pointed(spark: SparkSession, path: str) -> str:
    """The folder of the generation that was pointed to last."""
    row = _turns(spark, path).agg(F.max_by("generation", F.struct("turn", "generation")).alias("g")).first()
    return f"{path}/generation={row['g']}"


def watermark(spark: SparkSession, folder: str) -> int:
    """The highest sequence that has been applied; it never regresses, as mutations are only added."""
    return mutations(spark, folder).agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]


def _last(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("aggregate").agg(F.max_by(F.struct("sequence", "hash", "partition", "deleted"), F.struct("sequence", "batch")).alias("r"))
    return last.select("aggregate", "r.*")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The projection: the mutation of the highest sequence of each aggregate.

    Mutations are read with the schema given, so an empty folder is an empty projection.
    """
    return _last(mutations(spark, path))


def apply_batch(events: DataFrame, batch: int, documents: DataFrame, path: str) -> None:
    """Plan a batch against what earlier batches have written to its buckets, and write its mutations."""
    spark = events.sparkSession
    _make(spark, path)
    due = coalesce(events)
    touched = [r["bucket"] for r in due.select(bucket(F.col("aggregate"))).distinct().collect()]  # BUCKETS numbers at most
    state = _last(mutations(spark, path).where(F.col("bucket").isin(touched) & (F.col("batch") != batch)))
    todo = plan(due, state, documents).where(F.col("action").isin("delete", "upsert"))
    gone = F.col("action") == "delete"
    put(todo.select("aggregate", "sequence", F.when(~gone, F.col("hash")).alias("hash"), F.when(~gone, F.col("partition")).alias("partition"), gone.alias("deleted")), path, batch)


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Fold the batches up to ``upto`` into one that holds the last mutation of each aggregate, then drop them.

    The folded batch is whole before the others go; until then both give the same rows, as equal sequences are equal
    mutations.  Folded batches have negative numbers, of which later ones are lower.
    """
    _make(spark, path)
    old = [r["batch"] for r in mutations(spark, path).where(F.col("batch") <= upto).select("batch").distinct().collect()]  # as many as batches since the last fold
    into = -(upto + 2)
    if len([b for b in old if b != into]) < 2:
        return
    put(_last(mutations(spark, path).where(F.col("batch") <= upto)), path, into)
    for b in old:
        if b != into:
            _remove(spark, f"{path}/batch={b}")


def project(events: DataFrame, documents: DataFrame, path: str, checkpoint: str, fold_every: int = 50) -> StreamingQuery:
    """Project a stream of events until it is drained; ``documents`` is read anew by each batch.

    Every ``fold_every`` batches what came before is folded, so a read doesn't grow with the number of batches.
    """

    def step(df: DataFrame, batch: int) -> None:
        apply_batch(df, batch, documents, path)
        if batch and batch % fold_every == 0:
            fold(df.sparkSession, path, batch - 1)  # a batch that runs again finds its own folder

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The projection by partition: documents lie in the folder of their partition and move between them

PLACED = "aggregate long, sequence long, hash string, partition string, bucket int"
#: Where deleted documents leave their sequence, so that older events stay superseded.
GONE = "gone"


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The documents in their folders: conditions on ``partition`` and ``bucket`` prune files; deleted ones are in ``gone``."""
    _make(spark, path)
    return spark.read.schema(PLACED).parquet(path)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replace just the folders that ``rows`` fall in."""
    dealt = rows.select("aggregate", "sequence", "hash", "partition", "bucket").hint("rebalance", F.col("partition"), F.col("bucket"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition", "bucket").parquet(path)


def move(spark: SparkSession, changed: DataFrame, path: str, buckets: list[int] = []) -> None:  # noqa: B006
    """Put ``changed`` (``aggregate, sequence, hash, partition``) where they belong, then take them from where they were.

    Only folders of the touched buckets (and of ``buckets``) are read, and only those written that a document enters or
    leaves.  A document enters its new folder first: a step that is cut short leaves it in both, never in neither, and
    the next one that touches its bucket takes it from the old.  A folder is replaced when its new files are whole.
    """
    new = changed.select("aggregate", "sequence", "hash", F.coalesce("partition", F.lit(GONE)).alias("partition"), bucket(F.col("aggregate")))
    cells = [(r["partition"], r["bucket"]) for r in new.select("partition", "bucket").distinct().collect()]  # 3 * BUCKETS at most
    touched = sorted({b for _, b in cells} | set(buckets))
    if cells:
        here = placed(spark, path).where(F.col("bucket").isin(touched))
        entered = reduce(or_, ((F.col("partition") == p) & (F.col("bucket") == b) for p, b in cells))
        stay = here.where(entered).join(new.select("aggregate"), "aggregate", "left_anti")
        _overwrite(stay.unionByName(new), path)
    # What has a later sequence elsewhere, of this step or of one that was cut short, goes.
    here = placed(spark, path).where(F.col("bucket").isin(touched))
    last = here.groupBy("aggregate", "bucket").agg(F.max("sequence").alias("last"), F.count("*").alias("n"))
    marked = here.join(last.where("n > 1"), ["aggregate", "bucket"], "left").withColumn("old", F.coalesce(F.col("sequence") < F.col("last"), F.lit(False)))
    left = [(r["partition"], r["bucket"], r["rest"]) for r in marked.groupBy("partition", "bucket").agg(F.count_if("old").alias("gone"), F.count_if(~F.col("old")).alias("rest")).where("gone > 0").collect()]
    full = [(p, b) for p, b, rest in left if rest]
    if full:
        of = reduce(or_, ((F.col("partition") == p) & (F.col("bucket") == b) for p, b in full))
        _overwrite(marked.where(of & ~F.col("old")), path)
    for p, b, rest in left:
        if not rest:
            _remove(spark, f"{path}/partition={p}/bucket={b}")


def place_batch(events: DataFrame, documents: DataFrame, path: str) -> None:
    """Plan a batch against the documents in their folders and move what it touches; run again it changes nothing."""
    spark = events.sparkSession
    due = coalesce(events)
    touched = [r["bucket"] for r in due.select(bucket(F.col("aggregate"))).distinct().collect()]
    state = placed(spark, path).where(F.col("bucket").isin(touched))
    state = state.groupBy("aggregate").agg(F.max_by(F.struct("sequence", "hash", "partition"), "sequence").alias("r")).select("aggregate", "r.*")
    todo = plan(due, state, documents).where(F.col("action").isin("delete", "upsert"))
    gone = F.col("action") == "delete"
    # Written before it is applied: the plan reads the folders that it changes.
    planned = f"{path.rstrip('/')}-planned"
    todo.select("aggregate", "sequence", F.when(~gone, F.col("hash")).alias("hash"), F.when(~gone, F.col("partition")).alias("partition")).write.mode("overwrite").parquet(planned)
    changed = spark.read.schema("aggregate long, sequence long, hash string, partition string").parquet(planned)
    move(spark, changed, path, touched)


def project_placed(events: DataFrame, documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Project a stream of events into folders by partition until it is drained."""
    writer = events.writeStream.foreachBatch(lambda df, batch: place_batch(df, documents, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
