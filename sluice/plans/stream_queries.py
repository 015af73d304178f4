"""Streams over the test tables, drained into folders of the shared directory and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.plans.registry import Tables, query
from sluice.shared import shared_dir
from sluice.streaming import curation, outbox


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def streamed(t: Tables, table: str):
    """A table read as a stream, in the order in which its files come; as a pattern, so that it may be one file or a folder."""
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.dir}/{table}.parque[t]")


@query("""
WITH o AS (SELECT user_id, event_id, event_id % 4 // 2 AS hash, CASE WHEN value > 90 THEN NULL WHEN event_type IN ('error', 'purchase') THEN 'closed' ELSE 'active' END AS raw FROM events),
s AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status FROM o),
e AS (SELECT *, CASE WHEN lag(hash) OVER w IS NULL THEN 'new' WHEN hash <> lag(hash) OVER w THEN 'changed' WHEN status IS DISTINCT FROM lag(status) OVER w THEN 'status_changed' END AS event FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS key, event_id AS position, event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, status FROM e WHERE event IS NOT NULL""")
def curation_stream(t):
    """All events as observations of their users: keyed state, one batch for each file."""
    status = F.when(F.col("value") > 90, None).when(F.col("event_type").isin("error", "purchase"), "closed").otherwise("active")
    seen = streamed(t, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("position"), F.floor(F.col("event_id") % 4 / 2).alias("hash"), status.alias("status"), F.col("ts").alias("at"))
    path = folder(t, "curation")
    curation.curate(seen).writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(curation.EVENTS).parquet(f"{path}/events")


@query("""
WITH last AS (SELECT user_id AS aggregate, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1)
SELECT aggregate, CASE kind WHEN 'error' THEN 'gone' WHEN 'purchase' THEN 'archive' ELSE 'active' END AS partition FROM last""")
def placed_projection(t):
    """A change log projected in two batches into folders by partition, between which documents move."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "close").otherwise("upsert")
    log = t.events.select((F.col("event_id") + 1).alias("sequence"), F.col("user_id").alias("aggregate"), kind.alias("kind"), F.lit(None).cast("string").alias("status"))
    docs = t.events.select(F.col("user_id").alias("aggregate")).distinct().select("aggregate", F.concat(F.lit("h"), F.col("aggregate").cast("string")).alias("hash"), F.lit("active").alias("partition"))
    path = folder(t, "placed")
    half = t.events.agg(F.max("event_id")).first()[0] // 2
    for batch in (F.col("sequence") <= half, F.col("sequence") > half):
        outbox.place_batch(log.where(batch), docs, path)
    return outbox.placed(t.spark, path).select("aggregate", "partition")
