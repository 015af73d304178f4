"""Raw payloads in their store, listing pages as drafts, and a projection that is rebuilt while events arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.plans.registry import query
from sluice.plans.stream_queries import folder
from sluice.sources import listings, stores
from sluice.streaming import outbox

# Raw payloads


def payloads(t):
    month = F.format_string("2024-%02d-03 10:00:00", F.pmod("doc_id", F.lit(12)) + 1)
    kind = F.when(F.col("doc_id") % 3 == 0, "json").otherwise("html")
    return t.documents.where("text IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("slug"), month.alias("at"), kind.alias("kind"), F.col("text").alias("body"))


PAYLOADS_SQL = """
p AS (SELECT source AS slug, doc_id % 12 + 1 AS m, CASE WHEN doc_id % 3 = 0 THEN 'json' ELSE 'html' END AS kind, text AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
r AS (SELECT DISTINCT 'raw/' || slug || '/2024/' || lpad(m::VARCHAR, 2, '0') || '/' || sha256(body) || '.' || kind AS ref, body FROM p)
"""


@query(f"WITH {PAYLOADS_SQL} SELECT ref, length(body) AS n FROM r")
def raw_stored(t):
    """Every text as a raw payload: written, and read back under its name."""
    path = folder(t, "raw")
    stores.put_raw(payloads(t), path)
    return t.spark.read.parquet(path).select("ref", F.length("body").cast("long").alias("n"))


@query(f"WITH {PAYLOADS_SQL} SELECT ref FROM r WHERE length(body) % 7 = 0")
def raw_broken(t):
    """Payloads that were changed in the store are told from those that weren't."""
    path = folder(t, "raw")
    stores.put_raw(payloads(t), f"{path}/whole")
    kept = t.spark.read.parquet(f"{path}/whole")
    torn = F.when(F.length("body") % 7 == 0, F.concat(F.col("body"), F.lit("!"))).otherwise(F.col("body"))
    kept.withColumn("body", torn).write.partitionBy("slug", "month").parquet(f"{path}/torn")
    return stores.broken(t.spark, f"{path}/torn")


# Listings


def pages(t):
    """A customer's orders as a page of a listing; some records lack a key, some a description, and every third page says too many."""
    k = F.col("o_orderkey")
    low = k % 30 + 60
    job = F.struct(
        F.when(k % 17 > 0, k).alias("id"), F.when(k % 34 > 0, F.concat(F.lit("R-"), k.cast("string"))).alias("referenceCode"), F.concat(F.lit("Order <b>"), F.substring("o_orderpriority", 3, 20), F.lit("</b>")).alias("title"),
        F.when(k % 11 > 0, F.format_string("<p>Tarief € %d,- tot € %d,- per uur</p><p>%s</p>", low, low + k % 20 + 1, F.col("o_orderstatus"))).alias("content"),
        F.col("n_name").alias("clientName"), F.element_at(F.array(F.lit("Ede, Gelderland"), F.lit("Zuid Holland"), F.lit("Elders")), (k % 3 + 1).cast("int")).alias("location"),
        (k % 16 + 8).alias("hoursPerWeekMin"), (k % 16 + 24).cast("string").alias("hoursPerWeekMax"),
    )
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    data = named.groupBy("o_custkey").agg(F.collect_list(job).alias("data"), F.count("*").alias("held"))
    body = F.struct((F.col("held") + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).alias("total"), "data")
    return data.select(F.col("o_custkey").alias("page"), F.to_json(body).alias("payload"))


@query("""
SELECT CASE WHEN o_orderkey % 17 > 0 THEN o_orderkey::VARCHAR WHEN o_orderkey % 34 > 0 THEN 'R-' || o_orderkey END AS ref, o_custkey AS page, 'Order ' || substr(o_orderpriority, 3, 20) AS title,
  CASE WHEN o_orderkey % 11 > 0 THEN 'Tarief € ' || (o_orderkey % 30 + 60) || ',- tot € ' || (o_orderkey % 30 + 60 + o_orderkey % 20 + 1) || ',- per uur ' || o_orderstatus END AS description, n_name AS client,
  CASE o_orderkey % 3 WHEN 0 THEN 'Gelderland' WHEN 1 THEN 'Zuid-Holland' END AS province, (o_orderkey % 16 + 8)::DOUBLE AS hours_min, (o_orderkey % 16 + 24)::DOUBLE AS hours_max,
  CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 30 + 60)::DOUBLE END AS low, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 30 + 60 + o_orderkey % 20 + 1)::DOUBLE END AS high, CASE WHEN o_orderkey % 11 > 0 THEN 'uur' END AS unit,
  concat_ws(',', CASE WHEN o_orderkey % 34 = 0 THEN 'no key' END, CASE WHEN o_orderkey % 11 = 0 THEN 'no description' END) AS problems
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def listing_drafts(t):
    """Pages of a listing as drafts, valid or with what they lack."""
    site = listings.SITES["striive"]
    found = listings.drafts(listings.records(pages(t), site), site, also=("page",))
    return found.select("ref", "page", "title", "description", "client", "province", "hours_min", "hours_max", F.col("rate.min").alias("low"), F.col("rate.max").alias("high"), F.col("rate.unit").alias("unit"), F.array_join("problems", ",").alias("problems"))


@query("""
WITH p AS (SELECT o_custkey, count(*) AS held FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT max(held + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS said, sum(held)::BIGINT AS held FROM p""")
def listing_totals(t):
    return listings.total(pages(t), listings.SITES["striive"]).select("said", F.col("held").cast("long").alias("held"))


# Rebuilding


@query("""
WITH h AS (SELECT max(event_id) // 2 AS half FROM events), l AS (SELECT user_id AS aggregate, arg_max(event_type, event_id) AS kind, max(event_id) + 1 AS seq FROM events WHERE event_id + 1 > (SELECT half FROM h) GROUP BY 1),
a AS (SELECT DISTINCT user_id AS aggregate FROM events)
SELECT aggregate, CASE WHEN kind IN ('error', 'purchase') THEN seq ELSE (SELECT half FROM h) END AS sequence, CASE kind WHEN 'error' THEN NULL WHEN 'purchase' THEN 'archive' ELSE 'active' END AS partition, coalesce(kind = 'error', false) AS deleted,
  (SELECT max(seq) FROM l WHERE kind IN ('error', 'purchase')) AS watermark FROM a LEFT JOIN l USING (aggregate)""")
def projection_rebuilt(t):
    """A generation is rebuilt up to a high-water mark, pointed to, and goes on with later events; those before it come again and change nothing."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "close").otherwise("upsert")
    log = t.events.select((F.col("event_id") + 1).alias("sequence"), F.col("user_id").alias("aggregate"), kind.alias("kind"), F.lit(None).cast("string").alias("status"))
    docs = t.events.select(F.col("user_id").alias("aggregate")).distinct().select("aggregate", F.concat(F.lit("h"), F.col("aggregate").cast("string")).alias("hash"), F.lit("active").alias("partition"))
    half = t.events.agg(F.max("event_id")).first()[0] // 2
    path, spark = folder(t, "rebuilt"), t.spark
    before = log.where(F.col("sequence") <= half)
    outbox.apply_batch(before, 0, docs, outbox.rebuild(docs.limit(0), path, "a"))
    outbox.point_to(spark, path, "a")
    outbox.rebuild(docs, path, "b", half)
    outbox.point_to(spark, path, "b")
    now = outbox.pointed(spark, path)
    for batch, events in enumerate((log.where(F.col("sequence") > half), before)):
        outbox.apply_batch(events, batch, docs, now)
    return outbox.current(spark, now).select("aggregate", "sequence", "partition", "deleted", F.lit(outbox.watermark(spark, now)).cast("long").alias("watermark"))
