"""Proposals read from postings, and what lands of each source's drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import html, proposals
from sluice.operators import coverage, telemetry
from sluice.plans.registry import query
from sluice.sources import replay

#: Labels that the sentences of a text get by turns, and the fields they belong to.
TURNS = (("place", "Standplaats"), ("client", "Opdrachtgever"), ("education", "Opleidingsniveau"), ("work_form", "Werkvorm"))
STRIPPED = r"trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
NOTHING_SQL = proposals.NOTHING.replace("'", "''")
_TURNS_SQL = " UNION ALL ".join(f"SELECT doc_id, {i} AS turn, '{field}' AS field, sentences[{i + 1}] AS sentence FROM s" for i, (field, _) in enumerate(TURNS))


@query(rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({STRIPPED}, '.'), lambda x: trim(x)), lambda x: x <> '') AS sentences FROM documents),
c AS (SELECT doc_id, field, sentence, nullif(trim(regexp_replace(CASE WHEN turn = 3 THEN sentence ELSE sentence || '.' END, '[.,;:]+$', '')), '') AS value FROM ({_TURNS_SQL}))
SELECT doc_id, field, value FROM c WHERE value IS NOT NULL AND (field NOT IN ('client', 'education') OR (length(value) >= 2 AND NOT regexp_matches(value, '{NOTHING_SQL}')))
UNION ALL SELECT doc_id, 'starts', strftime(DATE '2024-01-01' + (n_chars % 900)::INTEGER, '%Y-%m-%d') FROM documents WHERE n_chars % 3 < 2
UNION ALL SELECT doc_id, 'closes', strftime(DATE '2024-01-01' + (n_chars % 900)::INTEGER, '%Y-%m-%d') FROM documents WHERE n_chars % 5 > 0""")
def labelled_proposals(t):
    """Every sentence of every text behind a label, by turns, then two dates in several forms; the first of each label counts."""
    sentences = F.filter(F.transform(F.split(html.strip(F.col("text")), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    labels = F.array(*(F.lit(f"{label}: ") for _, label in TURNS))
    line = F.array_join(F.transform(sentences, lambda s, i: F.concat(F.get(labels, (i % len(TURNS)).cast("int")), s)), ". ")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 900).cast("int"))
    k = F.col("n_chars") % 3
    start = F.when(k == 0, F.date_format(date, "d-M-yyyy")).when(k == 1, F.date_format(date, "yyyy-MM-dd")).otherwise("zo snel mogelijk")
    close = F.when(F.col("n_chars") % 5 > 0, F.date_format(date, "dd/MM/yyyy")).otherwise("30-02-2024")
    posting = F.concat_ws(" ", line, F.lit("Startdatum:"), start, F.lit("Reageren tot:"), close)
    found = proposals.proposals(posting, fields=(*(f for f, _ in TURNS), "starts", "closes"))
    return t.documents.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.field", F.element_at("p.value", F.col("p.field")).alias("value"))


#: Which drafts made from the documents show each field, in SQL.
LANDED_SQL = {
    "client": "(doc_id % 4 > 0 AND source IS NOT NULL) OR doc_id % 8 = 0",
    "place": "lang IS NOT NULL AND lang <> 'es'",
    "rate": "n_chars % 3 = 0",
    "contract": "CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN false ELSE doc_id % 2 = 0 END",
    "work_form": "lang IS NOT NULL",
    "posted": "n_chars % 31 < 29",
    "closes": "n_chars % 7 = 0",
    "hours": "n_chars % 4 > 0",
    "education": "doc_id % 3 = 0",
    "starts": "doc_id % 6 = 0",
    "ends": "doc_id % 2 = 0",
    "duration": "doc_id % 9 > 0",
    "province": "lang = 'de'",
    "skills": "len(list_filter(string_split(text, ' ')[1:3], lambda x: trim(x) <> '' AND length(trim(x)) <= 80)) > 0",
}
_COUNTS = ", ".join(f"count(*) FILTER (n_chars % 10 > 0 AND ({test})) AS {field}" for field, test in LANDED_SQL.items())


@query(f"""
WITH c AS (SELECT coalesce(source, '-') AS source, count(*) FILTER (n_chars % 10 > 0) AS records, count(*) FILTER (n_chars % 10 = 0) AS rejected, {_COUNTS} FROM documents GROUP BY 1),
l AS (UNPIVOT c ON {", ".join(LANDED_SQL)} INTO NAME field VALUE landed)
SELECT source, field, records, rejected, landed, CASE WHEN records > 0 THEN round(landed / records, 6) END AS share FROM l""")
def drafts_coverage(t):
    """Documents as drafts, audited by source: all fourteen fields."""
    d, n = F.col("doc_id"), F.col("n_chars")
    own = F.struct(
        F.when(d % 8 == 0, "B").alias("opdrachtgever_naam"), F.when(d % 5 == 0, "ZZP").when(d % 5 == 1, "iets").alias("contracttype"), F.when(d % 2 == 0, "TEMPORARY, FULL_TIME").alias("employment_type"),
        F.col("lang").alias("werkvorm"), F.concat(F.lit("2024-02-"), F.lpad((n % 31 + 1).cast("string"), 2, "0")).alias("publicatiedatum"), (n % 4).alias("uren_per_week"),
        F.when(d % 3 == 0, "HBO").when(d % 3 == 1, " ").alias("opleidingsniveau"), F.when(d % 6 == 0, "2024-01-01").alias("start_datum"), F.when(d % 2 == 0, "2024-06-01").otherwise("cleared").alias("eindDatum"),
        F.when(d % 9 > 0, "4 maanden").otherwise("unknown").alias("periode"), F.when(F.col("lang") == "de", "Utrecht").otherwise("Brussel").alias("provincie"), F.slice(F.split("text", " "), 1, 3).alias("skills"),
    )
    none = F.lit(None).cast("double")
    drafts = t.documents.select(
        F.coalesce("source", F.lit("-")).alias("source"), F.when(d % 4 > 0, F.col("source")).alias("client"), F.when(F.col("lang") == "es", "unknown").otherwise(F.col("lang")).alias("place"),
        F.struct(F.when(n % 3 == 0, n.cast("double")).alias("min"), none.alias("max"), F.lit(None).cast("string").alias("unit")).alias("rate"), F.lit(None).cast("string").alias("starts"),
        F.when(n % 7 == 0, F.lit("2024-03-01").cast("timestamp")).alias("closes"), (n % 10 == 0).alias("rejected"), F.to_json(own).alias("extra"),
    )
    return coverage.audit(drafts, "source", "extra")


@query("""
WITH w AS (SELECT coalesce(source, '-') AS source, doc_id, string_split(coalesce(text, ''), ' ')[1] AS first, lang FROM documents)
SELECT source, 'lang' AS key, count(*) AS records FROM w WHERE trim(lang) <> '' GROUP BY 1 UNION ALL SELECT source, 'word', count(*) FROM w WHERE trim(first) <> '' AND first NOT IN ('unknown', 'cleared') GROUP BY 1
UNION ALL SELECT source, 'list', count(*) FROM w WHERE doc_id % 3 > 0 GROUP BY 1""")
def drafts_keys(t):
    """Keys that the drafts of each source fill."""
    word, some = F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0)), F.col("doc_id") % 3 > 0
    own = F.struct("lang", word.alias("word"), F.when(some, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("list"), F.lit("x").alias("_cleared"))
    return coverage.keys(t.documents.select(F.coalesce("source", F.lit("-")).alias("source"), F.to_json(own).alias("extra")), "source", "extra")


@query("""
WITH d AS (SELECT l_linestatus AS source, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS ref, l_linenumber AS pos, l_returnflag AS hash FROM lineitem),
l AS (SELECT source, ref, max((pos, hash)) AS last FROM d WHERE ref IS NOT NULL GROUP BY 1, 2),
s AS (SELECT o_orderstatus AS source, o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'N' END AS hash FROM orders),
o AS (SELECT l.source, count(*) FILTER (s.ref IS NULL) AS created, count(*) FILTER (s.hash <> last[2]) AS updated, count(*) FILTER (s.hash = last[2]) AS unchanged FROM l LEFT JOIN s ON s.source = l.source AND s.ref = l.ref GROUP BY 1),
n AS (SELECT source, count(*) AS observed, count(*) FILTER (ref IS NULL) AS rejected FROM d GROUP BY 1)
SELECT source, observed, coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(unchanged, 0) AS unchanged, rejected, observed - rejected - coalesce(created + updated + unchanged, 0) AS repeated FROM n LEFT JOIN o USING (source)""")
def replay_outcomes(t):
    """Lines as captured drafts against orders as stored versions."""
    line = F.col("l_linenumber")
    drafts = t.lineitem.select(F.col("l_linestatus").alias("source"), F.when(line != 7, F.col("l_orderkey")).alias("ref"), line.alias("pos"), F.col("l_returnflag").alias("hash"))
    first = t.orders.select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("ref"), F.lit("N").alias("hash"), F.lit(1).alias("version"))
    second = first.where("ref % 3 = 0").withColumns({"hash": F.lit("A"), "version": F.lit(2)})
    return replay.summary(replay.outcomes(drafts, first.unionByName(second)), drafts)


NOW = "2024-01-20 12:00:00"


@query(f"""
WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS run FROM orders GROUP BY 1),
h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN run END AS run, CASE c_custkey % 9 WHEN 1 THEN 'complete' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'backlogged' WHEN 4 THEN 'parked' WHEN 5 THEN 'quarantined' WHEN 6 THEN 'failed' WHEN 7 THEN 'odd' END AS outcome,
  CASE c_custkey % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'persist' WHEN 2 THEN 'curation' END AS phase, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 3 % 200 END AS phase_started, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 7 % 150 END AS moved,
  CASE WHEN c_custkey % 10 > 0 THEN c_custkey * 11 % 900 END AS success FROM customer LEFT JOIN o ON k = c_custkey WHERE c_custkey % 7 > 0),
j AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'blocked' WHEN c_custkey % 11 = 0 THEN 'inactive' WHEN c_custkey % 13 = 1 THEN 'blocked' END AS closed, h.outcome, h.phase, h.phase_started, h.moved, h.success, o_orderstatus AS st,
  CASE WHEN o_orderkey IS NOT NULL THEN greatest(0, date_diff('minute', o_orderdate, TIMESTAMP '{NOW}')) END AS begun, CASE WHEN h.phase = 'curation' THEN 60 ELSE 120 END AS budget,
  coalesce(o_orderstatus = 'O' OR (o_orderstatus = 'P' AND h.phase = 'curation'), false) AS running FROM customer LEFT JOIN h ON h.k = c_custkey LEFT JOIN orders ON o_orderkey = h.run),
p AS (SELECT *, CASE WHEN closed IS NOT NULL THEN 'source_' || closed WHEN NOT running THEN 'no_active_run' WHEN moved IS NULL AND coalesce(phase_started, begun) > budget THEN 'first_progress_overdue' WHEN moved IS NULL THEN 'progress_not_reported' WHEN moved > budget THEN 'progress_stalled' ELSE 'progressing' END AS progress,
  CASE WHEN closed IS NOT NULL THEN 'source_' || closed WHEN st = 'F' THEN 'current_run_incomplete' WHEN outcome IN ('parked', 'quarantined') THEN 'current_run_parked' WHEN outcome IN ('failed', 'incomplete') THEN 'current_run_incomplete' WHEN outcome = 'backlogged' THEN 'current_run_backlogged'
    WHEN outcome = 'odd' THEN 'current_run_unknown' WHEN success IS NULL THEN 'never_succeeded' WHEN k % 19 = 0 THEN 'freshness_policy_unknown' WHEN success > k % 5 * 60 + 5 THEN 'last_full_success_stale' ELSE 'last_full_success_fresh' END AS freshness FROM j)
SELECT k AS source, progress, freshness, CASE WHEN closed IS NOT NULL THEN closed WHEN progress IN ('first_progress_overdue', 'progress_stalled') THEN 'red' WHEN progress = 'progress_not_reported' THEN 'unknown' WHEN progress = 'progressing' THEN 'progressing'
  WHEN freshness IN ('current_run_unknown', 'never_succeeded', 'freshness_policy_unknown') THEN 'unknown' WHEN freshness = 'last_full_success_fresh' THEN 'green' ELSE 'red' END AS verdict,
  CASE WHEN closed IS NULL AND running AND moved IS NOT NULL THEN moved * 60000 END AS moved_ms FROM p""")
def telemetry_signals(t):
    """Customers as sources, their latest orders as the runs that their state names, nations as workers."""
    k, now = F.col("c_custkey"), F.lit(NOW).cast("timestamp")
    ago = lambda minutes: F.timestamp_millis(F.unix_millis(now) - minutes.cast("long") * 60_000)
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("timestamp").alias("run_started"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("run_status"))
    latest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("run"))
    sources = t.customer.select(k.alias("source"), (k % 11 > 0).alias("active"), F.when(k % 13 == 0, "blocked").when(k % 13 == 1, "draft").otherwise("ready").alias("status"), F.when(k % 17 == 0, "verboden").otherwise("toegestaan").alias("terms"))
    outcomes = F.array(*map(F.lit, ("complete", "incomplete", "backlogged", "parked", "quarantined", "failed", "odd")))
    success = F.when(k % 10 > 0, ago(k * 11 % 900))
    state = t.customer.where(k % 7 > 0).join(latest, "c_custkey", "left").select(
        k.alias("source"), F.when(k % 2 == 0, F.col("run")).alias("active_run"), F.when((k % 9).between(1, 7), F.get(outcomes, (k % 9 - 1).cast("int"))).alias("outcome"),
        F.get(F.array(*map(F.lit, telemetry.PHASES)), (k % 4).cast("int")).alias("phase"), F.when(k % 5 > 0, ago(k * 3 % 200)).alias("phase_started"), F.when(k % 3 > 0, ago(k * 7 % 150)).alias("progress_at"),
        success.alias("last_success"), F.when(k % 19 > 0, F.timestamp_millis(F.unix_millis(success) + k % 5 * 3_600_000)).alias("next_due"),
    )
    n = F.col("n_nationkey").cast("long")
    runtime = t.nation.select(
        n.cast("string").alias("component"), F.lit("running").alias("runtime_status"), ago(n).alias("runtime_updated"), ago(n).alias("heartbeat_at"), F.lit(600_000).cast("long").alias("heartbeat_ms"),
        ago(n * 2).alias("lock_checked_at"), F.lit(900_000).cast("long").alias("lock_ms"), F.lit(7_200_000).cast("long").alias("run_ms"), F.lit(3_600_000).cast("long").alias("curation_ms"),
    )
    told = telemetry.snapshot(sources, state, runs, runtime, "3", now)
    return told.select("source", F.col("progress.reason").alias("progress"), F.col("freshness.reason").alias("freshness"), F.col("aggregate.state").alias("verdict"), F.col("progress.age_ms").alias("moved_ms"))
