"""Records over time: places and scopes of search, merging, sweeps, windows, signals of sources."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import contracts, values
from sluice.operators import dedup, fetching, health, history, merging, relations, search, sweeping
from sluice.plans.analytics_queries import of_supplier
from sluice.plans.registry import Tables, query
from sluice.plans.search_queries import DOCS_SQL, NOW, docs
from sluice.shared import shared_dir
from sluice.streaming import outbox

AT = datetime(2024, 1, 20, 12, 0, tzinfo=timezone.utc)

# Places, units and scopes of search

PLACED_SQL = f"""
p AS (SELECT *, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 1 THEN 'Delft' ELSE 'Zwolle' END AS location, id % 12 = 0 AS location_unknown,
  CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN 'BE' ELSE 'NL' END AS country, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Overijssel' ELSE 'Zuid-Holland' END AS province,
  CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybride' END AS work_form, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'uur' ELSE 'dag' END AS rate_unit,
  CASE WHEN id % 8 > 0 THEN 'client ' || id % 40 END AS client FROM ({DOCS_SQL}))
"""


def placed(t: Tables) -> DataFrame:
    i = F.col("id")
    return docs(t).select(
        "*", F.when(i % 6 == 0, None).when(i % 3 == 1, "Delft").otherwise("Zwolle").alias("location"), (i % 12 == 0).alias("location_unknown"),
        F.when(i % 9 == 0, None).when(i % 4 == 0, "BE").otherwise("NL").alias("country"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, "Overijssel").otherwise("Zuid-Holland").alias("province"),
        F.when(i % 4 == 0, "remote").when(i % 4 == 1, "hybride").alias("work_form"), F.when(i % 3 == 1, "uur").when(i % 3 == 2, "dag").alias("rate_unit"),
        F.when(i % 8 > 0, F.concat(F.lit("client "), (i % 40).cast("string"))).alias("client"),
    )


@query(f"WITH {PLACED_SQL} SELECT id FROM p WHERE country IN ('BE') AND NOT location_unknown")
def search_filter_country(t):
    return placed(t).where(search.predicate(search.Filters(countries=["BE"]), NOW)).select("id")


@query(f"WITH {PLACED_SQL} SELECT id FROM p WHERE NOT location_unknown AND coalesce(location, country) IN ('Delft', 'NL')")
def search_filter_location(t):
    return placed(t).where(search.predicate(search.Filters(locations=["Delft", "NL"]), NOW)).select("id")


@query(f"WITH {PLACED_SQL} SELECT id FROM p WHERE province = 'Zuid-Holland' AND work_form IN ('remote', 'hybride') AND rate_unit = 'uur'")
def search_filter_exact(t):
    return placed(t).where(search.predicate(search.Filters(provinces=["Zuid-Holland"], work_forms=["remote", "hybride"], rate_units=["uur"]), NOW)).select("id")


@query(f"WITH {PLACED_SQL} SELECT id, rate_max FROM p ORDER BY CASE WHEN rate_unit IS NOT NULL THEN rate_max END DESC NULLS LAST, id LIMIT 40")
def search_sort_rate_comparable(t):
    return search.page(placed(t), "rate-high", 0, 40).select("id", "rate_max")


@query(f"WITH {PLACED_SQL} SELECT id, client FROM p ORDER BY client NULLS LAST, id LIMIT 30")
def search_sort_company(t):
    return search.page(placed(t), "company-asc", 0, 30).select("id", "client")


@query(f"WITH {PLACED_SQL} SELECT id FROM p WHERE contains(lower(concat_ws(' ', title, client)), 'client 1') OR contains(lower(concat_ws(' ', title, text, client)), 'of the')")
def search_client_in_scope(t):
    title, whole = search.haystack("title", "client"), search.haystack("title", "text", "client")
    return placed(t).where(search.term("client 1", title) | search.term("of the", whole)).select("id")


PARTITION_SQL = "CASE WHEN status IN ('closed', 'stale') OR coalesce(closing < TIMESTAMP '2024-07-01 12:03:20', false) OR coalesce(last_seen < TIMESTAMP '2024-07-01 12:03:20' - INTERVAL 20 DAY, false) THEN 'archive' ELSE 'active' END"


@query(f"WITH {PLACED_SQL} SELECT id, {PARTITION_SQL} AS partition FROM p")
def search_partition_recent(t):
    return placed(t).select("id", search.partition(NOW, 20).alias("partition"))


@query(f"WITH {PLACED_SQL} SELECT id, lang FROM p WHERE {PARTITION_SQL} = 'active' AND country = 'NL' AND NOT location_unknown")
def search_stored_active(t):
    path = f"{shared_dir(t.spark)}/search-{uuid.uuid4().hex}"
    search.store(placed(t).select("id", "lang", "country", "location_unknown", "status", "closing", "last_seen"), path, NOW, 20)
    return search.scope(t.spark.read.parquet(path), "active").where(search.predicate(search.Filters(countries=["NL"]), NOW)).select("id", "lang")


@query(f"""
WITH {PLACED_SQL} SELECT id, coalesce(rate_unit, CASE WHEN id % 2 = 0 THEN 'maand' WHEN id % 7 = 0 THEN 'jaar' END) AS rate_unit, coalesce(work_form, CASE WHEN id % 10 = 2 THEN 'op locatie' END) AS work_form,
  coalesce(contract, CASE WHEN id % 7 = 0 AND id % 3 = 0 THEN 'interim' END) AS contract FROM p""")
def search_projection_fallbacks(t):
    i = F.col("id")
    facts = F.create_map(
        F.lit("tarief_eenheid"), F.when(i % 2 == 0, "maand").when(i % 7 > 0, " "), F.lit("tariefEenheid"), F.when(i % 7 == 0, "jaar"),
        F.lit("werkvorm"), F.when(i % 10 == 2, "op locatie"), F.lit("contract_type"), F.when(i % 3 == 0, "interim"),
    )
    return search.projected(placed(t).withColumn("facts", facts)).select("id", "rate_unit", "work_form", "contract")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS preview FROM documents")
def search_preview(t):
    return t.documents.select("doc_id", values.preview(F.col("text")).alias("preview"))


@query("SELECT conv_id, turn, CASE WHEN turn * 86400000 <= (conv_id % 4) * 86400000 THEN [role] ELSE [] END AS people FROM conversations")
def contacts_within_retention(t):
    now = F.lit("2024-03-01").cast("timestamp")
    seen = F.timestamp_seconds(F.unix_timestamp(now) - F.col("turn") * 86_400)
    return t.conversations.select("conv_id", "turn", values.visible_contacts(F.array("role"), seen, F.col("conv_id") % 4, now).alias("people"))


# Merging

#: Stored and arriving facts of a document, by key; markers are one key of the stored ones.
FACTS_SQL = """
k AS (SELECT * FROM (VALUES ('locatie', 0), ('locatieTekst', 0), ('tarief', 1), ('werkvorm', 2)) v(key, grp)),
f AS (SELECT doc_id, key, grp, CASE WHEN (doc_id + length(key)) % 3 > 0 THEN 'old ' || key END AS old,
        CASE (doc_id + 2 * length(key)) % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'CLEARED' WHEN 3 THEN 'new ' || key ELSE NULL END AS new,
        doc_id % 4 = 0 AND grp = 0 AS marked FROM documents, k),
g AS (SELECT doc_id, grp, bool_or(coalesce(new = 'CLEARED', false)) AS clears, bool_or(coalesce(trim(new) NOT IN ('', 'CLEARED'), false)) AS lifts, bool_or(marked) AS was FROM f GROUP BY 1, 2)
"""
NAMES = {0: "locatie,locatieTekst,locatie_tekst", 1: "tarief,tariefEenheid,tariefMax,tariefMin,tarief_eenheid,tarief_max,tarief_min", 2: "werkvorm"}


@query(f"""
WITH {FACTS_SQL},
facts AS (SELECT doc_id, string_agg(key || '=' || v, ';' ORDER BY key) AS facts FROM (
  SELECT doc_id, key, CASE WHEN new = 'CLEARED' THEN NULL WHEN trim(new) <> '' THEN new ELSE old END AS v FROM f) WHERE v IS NOT NULL GROUP BY 1),
marks AS (SELECT doc_id, string_agg(CASE grp WHEN 0 THEN '{NAMES[0]}' WHEN 1 THEN '{NAMES[1]}' ELSE '{NAMES[2]}' END, ',' ORDER BY grp) AS marks FROM g WHERE clears OR (was AND NOT lifts) GROUP BY 1)
SELECT d.doc_id, coalesce(facts, '') AS facts, coalesce(marks, '') AS marks FROM documents d LEFT JOIN facts USING (doc_id) LEFT JOIN marks USING (doc_id)""")
def facts_merge(t):
    d = F.col("doc_id")
    old, new = [], []
    for key in ("locatie", "locatieTekst", "tarief", "werkvorm"):
        turn = (d + 2 * len(key)) % 5
        old += [F.lit(key), F.when((d + len(key)) % 3 > 0, f"old {key}")]
        new += [F.lit(key), F.when(turn == 1, " ").when(turn == 2, "CLEARED").when(turn == 3, f"new {key}")]
    stored = F.map_filter(F.create_map(*old), lambda k, v: v.isNotNull())
    marked = F.when(d % 4 == 0, F.array(F.lit("locatie"), F.lit("locatieTekst"), F.lit("locatie_tekst"))).otherwise(F.array().cast("array<string>"))
    out = t.documents.select("doc_id", merging.merged(stored, marked, F.create_map(*new)).alias("m"))
    return out.select("doc_id", merging.written(F.col("m.facts")).alias("facts"), F.array_join("m.marked", ",").alias("marks"))


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'a' END, CASE WHEN event_id % 3 = 0 THEN 'b' END, CASE WHEN event_id % 5 = 0 THEN 'c' END) AS contract,
  coalesce(CASE WHEN event_id % 4 = 0 THEN '32' END, CASE WHEN event_id % 7 = 0 THEN '40' END) AS hours FROM events""")
def facts_to_columns(t):
    i = F.col("event_id")
    json = F.to_json(F.struct(
        F.when(i % 2 == 0, "a").otherwise("  ").alias("contracttype"), F.when(i % 3 == 0, "b").alias("contract_type"), F.when(i % 5 == 0, "c").alias("employment_type"),
        F.when(i % 4 == 0, "32").alias("uren_per_week"), F.when(i % 7 == 0, "40").alias("uren_per_week_raw"),
    ))
    facts = t.events.select("event_id", F.from_json(json, "map<string,string>").alias("f"))
    return facts.select("event_id", *(merging.first_said(F.col("f"), merging.COLUMN_KEYS[c]).alias(c) for c in ("contract", "hours")))


@query("""
WITH p AS (SELECT o_custkey AS c_custkey, o_orderkey, (o_orderkey % 9)::BIGINT AS expected, CASE WHEN o_orderkey % 11 > 0 THEN 'p' || o_orderkey END AS proposal, (o_orderkey % 100) / 100.0 AS confidence FROM orders),
c AS (SELECT c_custkey, (c_custkey % 9)::BIGINT AS token, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' END AS value FROM customer WHERE c_custkey % 10 > 0)
SELECT c_custkey, CASE WHEN NOT coalesce(token = expected, false) THEN 'stale' WHEN coalesce(trim(value), '') = '' AND proposal IS NOT NULL AND confidence >= 0.85 THEN 'applied' ELSE 'nothing_to_fill' END AS outcome,
  CASE WHEN coalesce(token = expected, false) AND coalesce(trim(value), '') = '' AND proposal IS NOT NULL AND confidence >= 0.85 THEN proposal ELSE value END AS value
FROM p LEFT JOIN c USING (c_custkey)""")
def enrichment_guarded_fill(t):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    current = t.customer.where(c % 10 > 0).select(c, (c % 9).cast("long").alias("token"), F.when(c % 3 == 0, F.col("c_name")).when(c % 3 == 1, " ").alias("value"))
    proposals = t.orders.select(F.col("o_custkey").alias("c_custkey"), (o % 9).cast("long").alias("expected"), F.when(o % 11 > 0, F.concat(F.lit("p"), o.cast("string"))).alias("proposal"), (o % 100 / 100).alias("confidence"))
    return merging.guarded_fill(current, proposals, "c_custkey", "token", "value")


@query("""
SELECT l_orderkey, l_partkey, min(l_quantity) AS l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_linenumber = 1 AND e.l_orderkey = l.l_orderkey AND e.l_partkey = l.l_partkey)
GROUP BY 1, 2""")
def replay_idempotent(t):
    existing = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    return merging.without_repeats(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), existing, ["l_orderkey", "l_partkey"])


@query("""
WITH moved AS (SELECT l_suppkey - CASE WHEN l_suppkey % 4 = 1 AND l_suppkey > 1 THEN 1 ELSE 0 END AS source, l_orderkey, l_quantity, l_suppkey % 4 = 1 AND l_suppkey > 1 AS came, l_suppkey FROM lineitem)
SELECT source, l_orderkey, arg_min(l_quantity, (came, CASE WHEN came THEN l_suppkey ELSE 0 END, l_quantity)) AS l_quantity FROM moved GROUP BY 1, 2""")
def merge_duplicate_sources(t):
    pairs = t.supplier.where("s_suppkey % 4 = 1 AND s_suppkey > 1").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - 1).alias("new"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("source"), "l_orderkey", "l_quantity")
    return merging.renamed_members(rows, pairs, "source", ["l_orderkey"])


# Sweeps

DOMINATED_SQL = """
e AS (SELECT event_id, user_id, event_type, ts, event_id % 3 > 0 AS counts, event_id % 4 = 0 AS applied FROM events),
dom AS (SELECT a.event_id, arg_max(b.event_id, (b.applied, b.ts, b.event_id)) AS later_key, arg_max(b.ts, (b.applied, b.ts, b.event_id)) AS later_at
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts AND b.counts GROUP BY 1)
"""


def dominated(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return sweeping.dominators(rows, ["user_id", "event_type"], F.col("event_id") % 3 > 0, F.col("event_id") % 4 == 0, "ts", "event_id").select("event_id", "later_key", "later_at")


@query(f"WITH {DOMINATED_SQL} SELECT * FROM dom")
def dominated_applied_first(t):
    return dominated(t)


@query(f"WITH {DOMINATED_SQL} SELECT * FROM dom ORDER BY event_id LIMIT 5000")
def dominated_sweep(t):
    return sweeping.next_dominated(dominated(t), "event_id")


#: Observations by order line, the stored pointer by order; both say when, in which run, and with which hash and payload.
@query("""
WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, date_trunc('month', l_shipdate) AS started, l_shipdate AS observed, l_suppkey % 3 AS run, l_returnflag AS hash, l_linestatus AS ref, l_partkey % 2 = 0 AS pending FROM lineitem),
c AS (SELECT k, started, observed, run, hash, ref, CASE k % 5 WHEN 0 THEN 'lifecycle' WHEN 1 THEN 'ambiguous' ELSE 'observation' END AS phase FROM o WHERE n = 1 AND k % 7 > 0),
j AS (SELECT o.*, c.k IS NULL AS none, c.phase, o.run = c.run AS same_run, o.hash = c.hash AS same_hash, o.ref = c.ref AS same_ref,
  (o.started, o.observed, o.run, o.hash, o.ref) < (c.started, c.observed, c.run, c.hash, c.ref) AS behind, (o.started, o.observed, o.run, o.hash, o.ref) = (c.started, c.observed, c.run, c.hash, c.ref) AS level FROM o LEFT JOIN c ON o.k = c.k)
SELECT k, n, CASE WHEN none THEN 'process' WHEN phase = 'ambiguous' THEN 'blocked_ordering' WHEN same_run AND phase = 'lifecycle' THEN 'process'
  WHEN pending AND phase = 'observation' AND same_run AND same_hash AND same_ref THEN 'already_committed' WHEN NOT pending AND level THEN 'process' WHEN pending AND same_hash AND (behind OR level) THEN 'unchanged'
  WHEN behind THEN 'superseded' WHEN level THEN 'blocked_ordering' ELSE 'process' END AS disposition FROM j""")
def recovery_disposition(t):
    when = lambda name: F.col(name).cast("timestamp")
    seen = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 2 == 0).alias("pending"),
        F.struct(F.date_trunc("month", "l_shipdate").alias("started"), when("l_shipdate").alias("observed"), (F.col("l_suppkey") % 3).alias("run"), F.col("l_returnflag").alias("hash"), F.col("l_linestatus").alias("ref")).alias("candidate"),
    )
    phase = F.when(F.col("k") % 5 == 0, "lifecycle").when(F.col("k") % 5 == 1, "ambiguous").otherwise("observation")
    stored = seen.where("n = 1 AND k % 7 > 0").select("k", F.struct("candidate.*", phase.alias("phase")).alias("current"))
    return seen.join(stored, "k", "left").select("k", "n", sweeping.disposition(F.col("candidate"), F.col("current"), F.col("pending")).alias("disposition"))


@query(f"WITH {PLACED_SQL}, q AS (SELECT *, {PARTITION_SQL.split(' OR coalesce(closing')[0]} THEN 'archive' ELSE 'active' END AS partition FROM p) SELECT id FROM q WHERE partition = 'active' AND id % 13 > 0 AND closing < TIMESTAMP '2024-07-01 12:03:20' AND id % 5 <> 2 ORDER BY id LIMIT 2000")
def expiry_sweep(t):
    d = placed(t).withColumn("partition", F.when(F.col("status").isin("closed", "stale"), "archive").otherwise("active"))
    d = d.withColumn("superseded_by", F.when(F.col("id") % 13 == 0, F.col("id") + 1))
    return sweeping.expired(d, t.documents.where("doc_id % 5 = 2").select(F.col("doc_id").alias("id")), "id", NOW)


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 OR ts + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def outbox_prune(t):
    processed = F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return sweeping.retained(t.events.withColumn("processed", processed), AT, 7).select("event_id")


@query("SELECT user_id, min(ts) AS first_created FROM events WHERE event_type <> 'click' GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def oldest_identities(t):
    return sweeping.oldest_first(t.events.where("event_type <> 'click'"), "user_id", "ts", 25)


@query("""
SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-19 12:00:00') AS in_24u, count(*) FILTER (ts >= TIMESTAMP '2024-01-13 12:00:00') AS in_7d, count(*) FILTER (ts >= TIMESTAMP '2023-12-21 12:00:00') AS in_30d
FROM events GROUP BY 1""")
def runs_named_windows(t):
    return sweeping.by_windows(t.events.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type", AT)


@query("SELECT event_id, timezone('Europe/Amsterdam', timezone('UTC', ts - INTERVAL 24 HOUR))::DATE AS since FROM events")
def poll_window(t):
    return t.events.select("event_id", sweeping.poll_since(F.col("ts").cast("timestamp")).alias("since"))


@query("SELECT pos::INTEGER AS pos, doc_id FROM (VALUES (0, 7), (1, 3), (2, 99)) v(pos, asked) JOIN documents ON doc_id = CASE WHEN asked % 2 = 1 AND asked > 50 THEN asked - 1 ELSE asked END ORDER BY pos")
def batch_lookup_live(t):
    chain = t.documents.select(F.col("doc_id").alias("id"), F.when((F.col("doc_id") % 2 == 1) & (F.col("doc_id") > 50), F.col("doc_id") - 1).alias("next"))
    return relations.live_lookup(t.documents.select("doc_id"), chain, "doc_id", [7, 3, 99, 7, 98, -1]).select("pos", "doc_id")


# Signals of sources

SOURCE_SQL = """
s AS (SELECT c_custkey AS k, c_custkey % 20 > 0 AS active, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey * 17) % 5000 END AS ran, CASE c_custkey % 4 WHEN 0 THEN 'failed' ELSE 'succeeded' END AS last_status,
  CASE c_custkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN NULL ELSE 'closed' END AS circuit, c_custkey % 30 = 7 AS scheduler_stale, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey * 7) % 1200 - 600 END AS late,
  (c_custkey % 5)::BIGINT AS failed_24h, CASE WHEN c_custkey % 3 = 0 THEN 'timeout' END AS failure_code, c_custkey % 10 = 4 AS silence_open, c_custkey % 12 = 5 AS quiet FROM customer),
c AS (SELECT k, active, ran IS NULL AS never_run, coalesce(circuit <> 'closed', false) AS circuit_open, scheduler_stale, coalesce(late >= 300, false) AS overdue, failed_24h, last_status, failure_code IS NOT NULL AS error, silence_open, quiet FROM s)
"""


@query(f"""
WITH {SOURCE_SQL} SELECT k, CASE WHEN NOT active THEN 'inactive:info' ELSE concat_ws(',', CASE WHEN never_run THEN 'never_run:warning' END, CASE WHEN circuit_open THEN 'circuit_open:critical' END, CASE WHEN scheduler_stale THEN 'scheduler_stale:critical' END,
  CASE WHEN overdue THEN CASE WHEN circuit_open THEN 'schedule_overdue:critical' ELSE 'schedule_overdue:warning' END END, CASE WHEN failed_24h >= 3 THEN 'recent_failures:critical' WHEN failed_24h > 0 THEN 'recent_failures:warning' END,
  CASE WHEN error THEN CASE WHEN last_status = 'failed' THEN 'latest_error:critical' ELSE 'latest_error:warning' END END, CASE WHEN silence_open THEN 'silence_open:warning' END, CASE WHEN quiet THEN 'zero_activity:info' END) END AS signals,
  CASE WHEN NOT active THEN 'inactive' WHEN circuit_open OR scheduler_stale OR failed_24h >= 3 OR (error AND last_status = 'failed') THEN 'critical' WHEN never_run OR overdue OR failed_24h > 0 OR error OR silence_open THEN 'warning' ELSE 'healthy' END AS verdict FROM c""")
def source_nine_signals(t):
    k, now = F.col("c_custkey"), F.lit(AT)
    ago = lambda seconds: F.timestamp_seconds(F.unix_timestamp(now) - seconds)
    rows = t.customer.select(
        k.alias("k"), (k % 20 > 0).alias("active"), F.when(k % 9 > 0, ago(k * 17 % 5000)).alias("last_run_at"), F.when(k % 4 == 0, "failed").otherwise("succeeded").alias("last_status"),
        F.when(k % 8 == 0, "open").when(k % 8 > 1, "closed").alias("circuit"), (k % 30 == 7).alias("scheduler_stale"), F.when(k % 6 > 0, ago(k * 7 % 1200 - 600)).alias("next_run_at"),
        (k % 5).alias("failed_24h"), F.when(k % 3 == 0, "timeout").alias("failure_code"), (k % 10 == 4).alias("silence_open"), (k % 12 == 5).alias("quiet"),
    )
    found = rows.select("k", "active", health.source_signals(now).alias("s"))
    return found.select("k", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["code"], x["level"])), ",").alias("signals"), health.verdict(F.col("s"), F.col("active")).alias("verdict"))


@query("""
SELECT c_custkey, s.runs, o.last_order, coalesce(n.open_orders, 0) AS open_orders, l.at AS checked FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS runs FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS open_orders FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) n ON n.o_custkey = c_custkey LEFT JOIN (SELECT DATE '2024-01-20' AS at) l ON true""")
def source_health_joins(t):
    per = lambda test, what: t.orders.where(test).groupBy(F.col("o_custkey").alias("c_custkey")).agg(what)
    out = t.customer.select("c_custkey").join(per("true", F.count("*").alias("runs")), "c_custkey", "left")
    out = out.join(per("o_orderstatus = 'F'", F.max("o_orderkey").alias("last_order")), "c_custkey", "left")
    out = out.join(per("o_orderstatus = 'O'", F.count("*").alias("open_orders")), "c_custkey", "left")
    return out.select("c_custkey", "runs", "last_order", F.coalesce("open_orders", F.lit(0)).alias("open_orders"), F.lit("2024-01-20").cast("date").alias("checked"))


@query("SELECT event_id AS id FROM events WHERE value > 90 AND ts <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR AND event_id % 4 > 0")
def alerts_to_escalate(t):
    alerts = t.events.select(F.col("event_id").alias("id"), (F.col("value") > 90).alias("open"), F.col("ts").cast("timestamp").alias("created"))
    return health.to_escalate(alerts, t.events.where("event_id % 4 = 0").select(F.col("event_id").alias("id")), F.lit(AT), 3600)


# Texts and counts

CODES = ["NL36", " nl364 ", "XX1", "", "NL3", "NL41"]
REGION_CASES = "CASE doc_id % 4 WHEN 0 THEN 'Zuidoost-Zuid-Holland' WHEN 1 THEN 'Kop Van Noord-Holland' WHEN 2 THEN 'Groot Eigen' ELSE NULL END"


@query(f"SELECT doc_id, {REGION_CASES} AS region FROM documents")
def text_region(t):
    code = lambda c, n=None: F.struct(F.lit(c).alias("code"), F.lit(n).cast("string").alias("name"))
    k = F.col("doc_id") % 4
    codes = (
        F.when(k == 0, F.array(code("NL36"), code(" nl364 "), code("XX1")))
        .when(k == 1, F.array(code("NL321"), code("NL321", "KOP  VAN noord-holland".upper()), code("NL3")))
        .when(k == 2, F.array(code("NL41", "Groot Eigen"), code("")))
        .otherwise(F.array(code("XX"), code("", "Nergens")))
    )
    return t.documents.select("doc_id", values.region(codes).alias("region"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_ms(date_trunc('day', ts)) WHEN 1 THEN epoch_ms(date_trunc('second', ts)) + 123 WHEN 2 THEN epoch_ms(date_trunc('second', ts)) - 7200000 WHEN 3 THEN epoch_ms(date_trunc('minute', ts)) END AS at_ms FROM events""")
def text_publication(t):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    of = lambda form: F.date_format(ts, form)
    written = (
        F.when(k == 0, of("yyyy-MM-dd")).when(k == 1, F.concat(of("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123987"))).when(k == 2, F.concat(of("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(k == 3, of("yyyy-MM-dd'T'HH:mm")).when(k == 4, F.lit("2024-02-30")).otherwise(of("yyyy-MM-dd HH:mm"))
    )
    return t.events.select("event_id", F.unix_millis(values.publication(written)).alias("at_ms"))


@query("SELECT doc_id, doc_id % 3 = 0 AS fallback FROM documents")
def text_title_fallback(t):
    d = F.col("doc_id").cast("string")
    stands = values.title_fallback(F.lit("Title"), F.col("source"), d)
    text = F.when(F.col("doc_id") % 3 == 0, stands).otherwise(F.concat(stands, F.lit(" ")))
    return t.documents.select("doc_id", (text == stands).alias("fallback"))


@query("""
WITH f AS (SELECT coalesce(lang, '?') AS lang, count(*) AS n FROM documents GROUP BY 1)
SELECT sha256('{"c0":' || (SELECT count(*) FROM documents) || ',"c1":"' || (SELECT string_agg(lang || ':' || n, ',' ORDER BY lang) FROM f) || '"}') AS digest""")
def search_result_digest(t):
    per = t.documents.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"))
    both = per.agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", F.col("n").cast("string")))), ",").alias("facets"))
    return both.select(values.digest(F.col("total"), F.col("facets")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'active' ELSE 'archive' END || ':' || sha256('{"c0":' || doc_id || ',"c1":' || coalesce('"' || source || '"', 'null') || '}') AS hash FROM documents""")
def projection_hashes(t):
    half = F.when(F.col("doc_id") % 2 == 0, "active").otherwise("archive")
    return t.documents.select("doc_id", values.projection_hash(half, F.col("doc_id"), F.col("source")).alias("hash"))


@query("SELECT p_partkey, (contains(lower(p_name || ' ' || p_type), 'ring')::INTEGER + contains(lower(p_name || ' ' || p_type), 'economy')::INTEGER + contains(lower(p_name || ' ' || p_type), 'red')::INTEGER) AS score FROM part WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 5")
def recipe_ranking(t):
    score = values.keyword_score(F.concat_ws(" ", "p_name", "p_type"), "Ring, economy? red x")
    return t.part.select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(5)


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS failed, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def duration_cohorts(t):
    disc = lambda s: F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 9 == 0).alias("failed"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.sum("value"), 2).alias("total"))


NORM_SQL = r"n AS (SELECT page_id, page_id % 3 = 0 AS legacy, regexp_replace(regexp_replace(lower(trim(split_part(split_part(url, '#', 1), '?', 1))), '/+$', ''), '/[^/]*$', '') AS norm FROM pages)"


def normed(t: Tables) -> DataFrame:
    norm = F.regexp_replace(dedup.normal_url(F.col("url")), "/[^/]*$", "")
    return t.pages.select("page_id", (F.col("page_id") % 3 == 0).alias("legacy"), norm.alias("norm"))


@query(f"""
WITH {NORM_SQL}, g AS (SELECT norm, count(*) AS n, bool_and(legacy) AS only_old, bool_and(NOT legacy) AS only_new FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT CASE WHEN only_old THEN 'only legacy' WHEN only_new THEN 'only live' ELSE 'mixed' END AS kind, count(*) AS "groups", sum(n)::BIGINT AS "rows" FROM g GROUP BY 1""")
def url_group_kinds(t):
    return dedup.group_kinds(normed(t), "norm", "legacy")


@query(f"""
WITH {NORM_SQL}, k AS (SELECT *, page_id % 5 AS source FROM n),
g AS (SELECT source, norm, count(*) AS n, count(DISTINCT page_id) AS keys, min(page_id) AS survivor FROM k GROUP BY 1, 2), s AS (SELECT source, count(*) AS live FROM k GROUP BY 1)
SELECT source, norm, survivor FROM g JOIN s USING (source) WHERE n = 2 AND keys = 2 AND source <> 3 AND 2.0 / live <= 0.05""")
def url_dedup_guarded(t):
    rows = normed(t).withColumn("source", F.col("page_id") % 5)
    return dedup.guarded_pairs(rows, "source", "norm", "page_id", [3], 0.05)


@query("SELECT source, lang, count(*) AS n, count(DISTINCT n_chars) AS different FROM documents GROUP BY 1, 2")
def counts_by_source_and_place(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("n_chars").alias("different"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_no_live_claim(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT "group", source, count(*) AS items FROM (
  SELECT DISTINCT l_partkey AS "group", s_name AS source, l_orderkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 30 OR l_returnflag = 'R') GROUP BY 1, 2""")
def overlap_members(t):
    direct, linked = (of_supplier(t.lineitem.where(test), t) for test in ("l_quantity > 30", "l_returnflag = 'R'"))
    return relations.memberships(direct, linked).groupBy("group", "source").agg(F.count("*").alias("items"))


# Enrichment, coverage and events of curation

PROPOSALS_SQL = """
pr AS (SELECT doc_id, field, 'v' || (doc_id % 7) || field || k AS value, ((doc_id * k + length(field)) % 21) / 20.0 AS confidence FROM documents, (VALUES ('lang'), ('source'), ('text')) f(field), (VALUES (1), (2), (3)) n(k) WHERE doc_id % 3 > 0),
best AS (SELECT doc_id, field, max(confidence) AS confidence, arg_max(value, (confidence, value)) AS value FROM pr GROUP BY 1, 2)
"""


def proposals(t: Tables) -> DataFrame:
    names, turns = F.array(*map(F.lit, ("lang", "source", "text"))), F.array(*map(F.lit, (1, 2, 3)))
    long = t.documents.where("doc_id % 3 > 0").select("doc_id", F.explode(names).alias("field")).select("doc_id", "field", F.explode(turns).alias("k"))
    value = F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string"), "field", F.col("k").cast("string"))
    return long.select("doc_id", "field", value.alias("value"), ((F.col("doc_id") * F.col("k") + F.length("field")) % 21 / 20).alias("confidence"))


@query(f"WITH {PROPOSALS_SQL} SELECT doc_id, field, value, confidence::DOUBLE AS confidence, CASE WHEN confidence >= 0.85 THEN 'apply' WHEN confidence >= 0.8 THEN 'badge' ELSE 'none' END AS use FROM best")
def enrichment_best_proposals(t):
    return merging.best_proposals(proposals(t), "doc_id").select("doc_id", "field", "value", "confidence", "use")


@query(f"""
WITH {PROPOSALS_SQL}, d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN 'T (' || doc_id || ')' ELSE 'own' END AS text FROM documents),
a AS (SELECT * FROM best WHERE confidence >= 0.85)
SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(l.value, d.lang) ELSE d.lang END AS lang, CASE WHEN d.doc_id % 5 = 0 OR d.source IS NULL THEN coalesce(s.value, d.source) ELSE d.source END AS source, CASE WHEN d.doc_id % 4 = 0 THEN coalesce(x.value, d.text) ELSE d.text END AS text
FROM d LEFT JOIN a l ON l.doc_id = d.doc_id AND l.field = 'lang' LEFT JOIN a s ON s.doc_id = d.doc_id AND s.field = 'source' LEFT JOIN a x ON x.doc_id = d.doc_id AND x.field = 'text'""")
def enrichment_overlay_fields(t):
    d = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", F.when(d % 2 != 0, F.col("lang")).alias("lang"), F.when(d % 5 == 0, " ").otherwise(F.col("source")).alias("source"),
        F.when(d % 4 == 0, F.concat(F.lit("T ("), d.cast("string"), F.lit(")"))).otherwise("own").alias("text"),
    )
    stand_in = {"text": F.concat(F.lit("T ("), F.col("doc_id").cast("string"), F.lit(")"))}
    return merging.overlay(rows, proposals(t), "doc_id", ["lang", "source", "text"], stand_in)


@query("""
SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 OR lang IS NULL THEN 'lang' END, CASE WHEN doc_id % 5 = 0 THEN 'source' END], lambda x: x IS NOT NULL) AS gaps FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0 OR lang IS NULL""")
def enrichment_candidates(t):
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(d % 2 != 0, F.col("lang")).alias("lang"), F.when(d % 5 > 0, "s").alias("source"))
    return merging.candidates(rows, "doc_id", ["lang", "source"])


ORDER_FIELDS = ["o_orderstatus", "o_orderdate", "o_custkey", "o_totalprice"]


@query("""
WITH o AS (SELECT o_custkey % 25 AS source, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE ' ' END AS o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS o_orderdate, o_custkey, CASE WHEN o_totalprice > 500 THEN o_totalprice END AS o_totalprice FROM orders)
SELECT source, field, count(*) AS n, sum(f)::BIGINT AS filled, round(avg(f), 6) AS coverage FROM (
  SELECT source, 'o_orderstatus' AS field, (trim(o_orderstatus) <> '')::INTEGER AS f FROM o UNION ALL SELECT source, 'o_orderdate', (o_orderdate IS NOT NULL)::INTEGER FROM o
  UNION ALL SELECT source, 'o_custkey', 1 FROM o UNION ALL SELECT source, 'o_totalprice', (o_totalprice IS NOT NULL)::INTEGER FROM o) GROUP BY 1, 2""")
def field_coverage_audit(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        (F.col("o_custkey") % 25).alias("source"), F.when(k % 4 > 0, F.col("o_orderstatus")).otherwise(" ").alias("o_orderstatus"),
        F.when(k % 5 > 0, F.col("o_orderdate")).alias("o_orderdate"), "o_custkey", F.when(F.col("o_totalprice") > 500, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return merging.coverage(rows, "source", ORDER_FIELDS)


@query("""
WITH e AS (SELECT user_id, event_id, event_type AS hash, CASE WHEN event_id % 3 > 0 THEN CASE WHEN value > 50 THEN 'active' ELSE 'closed' END END AS raw FROM events),
s AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status FROM e),
b AS (SELECT *, row_number() OVER w AS n, lag(hash) OVER w AS h0, lag(status) OVER w AS s0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'nieuw' WHEN hash IS DISTINCT FROM h0 THEN 'gewijzigd' WHEN status IS DISTINCT FROM s0 THEN 'status_gewijzigd' END AS kind FROM b)
SELECT user_id AS aggregate, count(kind) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version, kind, status, sha256(user_id || ':' || event_id || ':' || kind) AS id FROM k QUALIFY kind IS NOT NULL""")
def curation_outbox_events(t):
    status = F.when(F.col("event_id") % 3 > 0, F.when(F.col("value") > 50, "active").otherwise("closed"))
    seen = t.events.select("user_id", "event_id", F.col("event_type").alias("hash"), status.alias("status"))
    return history.curation_events(history.curate(seen, "user_id", "event_id"), "user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'replayed' WHEN o_orderkey IS NULL THEN 'new' WHEN l_returnflag = o_orderstatus THEN 'unchanged' ELSE 'changed' END AS outcome FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 > 0")
def arrival_replayed(t):
    known = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("hash"))
    arrived = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_returnflag").alias("hash"), (F.col("l_linenumber") == 3).alias("replayed"))
    return history.arrival(known, arrived, ["k"]).select(F.col("k").alias("l_orderkey"), "l_linenumber", "outcome")


@query("""
WITH i AS (SELECT l_orderkey AS k, count(*) AS copies FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'duplicate' AS reasons FROM orders JOIN i ON k = o_orderkey WHERE copies > 1 UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT k FROM i)""")
def inventory_duplicates(t):
    same = (F.lit("h").alias("hash"), F.lit("active").alias("partition"))
    return relations.inventory(t.orders.select("o_orderkey", *same), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *same), "o_orderkey")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'freelance' WHEN 1 THEN 'interim' WHEN 2 THEN 'vast' END AS form FROM documents")
def contract_resolved(t):
    k = F.col("doc_id") % 4
    token = F.when(k == 0, "zzp")
    tokens = F.when(k < 2, F.array(F.lit("TEMPORARY"), F.lit("FULL_TIME"))).when(k == 2, F.array(F.lit("zzp"), F.lit("vast")))
    text = F.when(k < 3, "een vaste baan").otherwise("iets anders")
    return t.documents.select("doc_id", contracts.resolved_contract(token, tokens, text).alias("form"))


@query("""
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def missed_references(t):
    seen = t.lineitem.where("l_returnflag = 'A'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey")
    runs = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("complete"))
    return fetching.missed(t.orders.select("o_custkey", "o_orderkey"), seen, runs, "o_custkey", "o_orderkey")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def repair_dry_run(t):
    d = F.col("doc_id").alias("aggregate")
    source = t.documents.where("doc_id % 3 > 0").select(d, F.lit("h").alias("hash"), F.lit("active").alias("partition"))
    return outbox.repair_counts(outbox.repairs(t.documents.where("doc_id % 2 = 0").select(d), source))
