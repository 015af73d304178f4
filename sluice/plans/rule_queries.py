"""Health signals, assessments, rebuilds and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import assessment, relations, signals
from sluice.plans.registry import Tables, query
from sluice.streaming import outbox

NOW = "2024-01-31 00:00:00"

#: Customers as sources; every telling column is derived from the customer's number, with ages in seconds.
SOURCES_SQL = """
s AS (SELECT c_custkey AS k, CASE c_custkey % 17 WHEN 0 THEN 'inactive' WHEN 1 THEN 'blocked' ELSE 'active' END AS source, c_custkey % 19 <> 0 AS available,
  CASE WHEN c_custkey % 13 > 0 THEN (c_custkey * 7) % 120 END AS beat, CASE WHEN c_custkey % 23 > 0 THEN 90 END AS beat_limit,
  CASE c_custkey % 11 WHEN 0 THEN 'waiting' WHEN 1 THEN 'lost' WHEN 2 THEN NULL ELSE 'held' END AS lock,
  c_custkey % 5 > 1 AS active, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey * 11) % 100 END AS mark, (c_custkey * 3) % 100 AS started,
  CASE c_custkey % 29 WHEN 0 THEN 'parked' WHEN 1 THEN 'unknown' END AS current, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey * 13) % 100 END AS success FROM customer)
"""


def sources(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ago = lambda seconds: F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - seconds)
    return t.customer.select(
        k.alias("k"), F.when(k % 17 == 0, "inactive").when(k % 17 == 1, "blocked").otherwise("active").alias("source"), (k % 19 != 0).alias("available"),
        F.when(k % 13 > 0, ago(k * 7 % 120)).alias("beat"), F.when(k % 23 > 0, 90).alias("beat_limit"),
        F.when(k % 11 == 0, "waiting").when(k % 11 == 1, "lost").when(k % 11 > 2, "held").alias("lock"),
        (k % 5 > 1).alias("active"), F.when(k % 3 > 0, ago(k * 11 % 100)).alias("mark"), ago(k * 3 % 100).alias("started"),
        F.when(k % 29 == 0, "parked").when(k % 29 == 1, "unknown").alias("current"), F.when(k % 7 > 0, ago(k * 13 % 100)).alias("success"),
    )


@query(f"""
WITH {SOURCES_SQL}
SELECT k, CASE WHEN source <> 'active' THEN source WHEN NOT available THEN 'unknown' WHEN beat > beat_limit THEN 'red' WHEN beat IS NULL OR beat_limit IS NULL THEN 'unknown'
    WHEN lock IN ('waiting', 'lost') THEN 'red' WHEN lock IS NULL THEN 'unknown'
    WHEN active AND coalesce(mark, started) > 60 THEN 'red' WHEN active AND mark IS NULL THEN 'unknown' WHEN active THEN 'progressing'
    WHEN current = 'parked' THEN 'red' WHEN current = 'unknown' OR success IS NULL THEN 'unknown' WHEN success > 50 THEN 'red' ELSE 'green' END AS state,
  CASE WHEN source <> 'active' THEN 'source_' || source WHEN NOT available THEN 'database_unknown' WHEN beat > beat_limit THEN 'worker_dead'
    WHEN beat IS NULL THEN 'process_telemetry_unknown' WHEN beat_limit IS NULL THEN 'process_policy_unknown'
    WHEN lock IN ('waiting', 'lost') THEN 'advisory_lock_not_owned' WHEN lock IS NULL THEN 'advisory_lock_unknown'
    WHEN active AND mark > 60 THEN 'progress_stalled' WHEN active AND mark IS NULL AND started > 60 THEN 'first_progress_overdue'
    WHEN active AND mark IS NULL THEN 'progress_unknown' WHEN active THEN 'progressing'
    WHEN current = 'parked' THEN 'freshness_stale' WHEN current = 'unknown' OR success IS NULL THEN 'freshness_unknown' WHEN success > 50 THEN 'freshness_stale' ELSE 'healthy' END AS reason
FROM s""")
def source_signals(t):
    now, minute = F.lit(NOW).cast("timestamp"), F.lit(60)
    rows = sources(t).withColumns({"probed": F.lit(NOW).cast("timestamp"), "lock_limit": minute, "mark_limit": minute, "success_limit": F.lit(50)})
    found = signals.observed(rows, now, heartbeat="beat", heartbeat_limit="beat_limit", lock_at="probed", running="active", progress_at="mark", progress_limit="mark_limit", run_state="current", success_at="success")
    return found.select("k", signals.conclusion().alias("f")).select("k", "f.state", "f.reason")


#: Parts as references, order lines as claims on orders; four fields, one of which nobody speaks about.
ASSESSED_SQL = """
r AS (SELECT p_partkey AS id, p_brand AS capability, CASE WHEN p_partkey % 9 > 0 THEN (p_partkey % 50 - 5) * 3600 END AS age, CASE WHEN p_partkey % 7 > 0 THEN 86400 END AS lim FROM part WHERE p_partkey % 5 > 0
      UNION ALL SELECT p_partkey, p_brand, (p_partkey % 50 - 5) * 3600, 86400 FROM part WHERE p_partkey % 45 = 1),
u AS (SELECT p_brand AS capability FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'none'),
c AS (SELECT l_orderkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'place' ELSE 'hours' END AS field, CASE WHEN l_returnflag = 'N' THEN 'known' ELSE 'unknown' END AS status, l_linestatus AS value, l_partkey AS id FROM lineitem WHERE l_orderkey % 8 < 4),
x AS (SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 8 < 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 80 = 1),
cells AS (SELECT DISTINCT item, field FROM x, (VALUES ('rate'), ('place'), ('hours'), ('start')) f(field))
"""


def references(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    seen = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - (k % 50 - 5) * 3600)
    of = lambda d, at, limit: d.select(k.alias("id"), F.col("p_brand").alias("capability"), at.alias("observed"), limit.cast("long").alias("limit"))
    return of(t.part.where(k % 5 > 0), F.when(k % 9 > 0, seen), F.when(k % 7 > 0, 86400)).unionByName(of(t.part.where(k % 45 == 1), seen, F.lit(86400)))


@query(f"""
WITH {ASSESSED_SQL}
SELECT 'DUPLICATE_SOURCE_REFERENCE' AS code, id::VARCHAR AS ref FROM (SELECT id, row_number() OVER (PARTITION BY id) AS n FROM r) WHERE n > 1
UNION ALL SELECT 'REFERENCE_CAPABILITY_NOT_USED', id::VARCHAR FROM r WHERE capability NOT IN (SELECT capability FROM u)
UNION ALL SELECT 'FUTURE_SOURCE_REFERENCE', id::VARCHAR FROM r WHERE age < 0
UNION ALL SELECT 'STALE_SOURCE_REFERENCE', id::VARCHAR FROM r WHERE age > lim
UNION ALL SELECT 'UNKNOWN_SOURCE_FRESHNESS', id::VARCHAR FROM r WHERE age IS NULL OR age < 0 OR lim IS NULL
UNION ALL SELECT 'USED_CAPABILITY_WITHOUT_REFERENCE', capability FROM (SELECT DISTINCT capability FROM u) WHERE capability NOT IN (SELECT capability FROM r)""")
def assess_references(t):
    used = t.part.where("p_size % 2 = 0").select(F.col("p_brand").alias("capability"))
    used = used.unionByName(t.spark.createDataFrame([("none",)], "capability string"))
    return assessment.reference_findings(references(t), used, NOW).select("code", "ref")


@query(f"""
WITH {ASSESSED_SQL}
SELECT 'CLAIM_OUTSIDE_SELECTION' AS code, item::VARCHAR AS item, field, NULL::VARCHAR AS ref FROM c WHERE item NOT IN (SELECT item FROM x)
UNION ALL SELECT 'DANGLING_SOURCE_REFERENCE', item::VARCHAR, field, id::VARCHAR FROM c WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT 'MISSING_FIELD_CONCLUSION', item::VARCHAR, field, NULL FROM cells WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.item = cells.item AND c.field = cells.field)
UNION ALL SELECT 'CONTRADICTORY_EVIDENCE', item::VARCHAR, field, NULL FROM (SELECT item, field FROM c JOIN cells USING (item, field) WHERE status = 'known' GROUP BY item, field HAVING count(DISTINCT value) > 1)
UNION ALL SELECT 'DUPLICATE_SELECTION_ID', item::VARCHAR, NULL, NULL FROM x GROUP BY item HAVING count(*) > 1""")
def assess_claims(t):
    line = F.col("l_linenumber") % 3
    field = F.when(line == 0, "rate").when(line == 1, "place").otherwise("hours")
    status = F.when(F.col("l_returnflag") == "N", "known").otherwise("unknown")
    claims = t.lineitem.where("l_orderkey % 8 < 4").select(F.col("l_orderkey").alias("item"), field.alias("field"), status.alias("status"), F.col("l_linestatus").alias("value"), F.array("l_partkey").alias("cited"))
    ids = t.orders.select(F.col("o_orderkey").alias("item"))
    selection = ids.where("item % 8 < 3").unionByName(ids.where("item % 80 = 1"))
    return assessment.claim_findings(claims, selection, references(t), ["rate", "place", "hours", "start"])


@query("""
WITH s AS (SELECT o_orderkey AS aggregate, md5(o_orderstatus) AS hash, CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'archive' END AS partition FROM orders WHERE o_orderkey % 10 <> 3),
i AS (SELECT o_orderkey AS aggregate, md5(CASE WHEN o_orderkey % 10 = 4 THEN 'x' ELSE o_orderstatus END) AS hash, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 <> 6 THEN 'active' ELSE 'archive' END AS partition FROM orders WHERE o_orderkey % 10 <> 5)
SELECT coalesce(s.aggregate, i.aggregate) AS aggregate, CASE WHEN s.aggregate IS NULL THEN 'delete' ELSE 'upsert' END AS action, s.hash, s.partition FROM s FULL JOIN i ON s.aggregate = i.aggregate
WHERE s.aggregate IS NULL OR i.aggregate IS NULL OR s.hash <> i.hash OR s.partition <> i.partition""")
def inventory_repair(t):
    k = F.col("o_orderkey")
    active = lambda test: F.when(test, "active").otherwise("archive").alias("partition")
    source = t.orders.where(k % 10 != 3).select(k.alias("aggregate"), F.md5("o_orderstatus").alias("hash"), active(k % 2 == 0))
    index = t.orders.where(k % 10 != 5).select(k.alias("aggregate"), F.md5(F.when(k % 10 == 4, "x").otherwise(F.col("o_orderstatus"))).alias("hash"), active((k % 2 == 0) & (k % 10 != 6)))
    return outbox.repairs(relations.inventory(source, index, "aggregate"), source)


@query("""
WITH d AS (SELECT doc_id AS aggregate, sha256('gen-2:' || doc_id) AS h FROM documents)
SELECT aggregate, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS event FROM d""")
def reindex_event_ids(t):
    return t.documents.select(F.col("doc_id").alias("aggregate"), outbox.rebuild_event_id("gen-2", F.col("doc_id")).alias("event"))
