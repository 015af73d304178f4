"""Change-log, fetching, export and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import dedup, exporting, fetching, ranking
from sluice.plans.registry import Tables, query
from sluice.streaming import outbox

LOG_SQL = """
log AS (SELECT event_id AS sequence, user_id AS aggregate, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'other' ELSE 'upsert' END AS kind,
  CASE WHEN event_type = 'purchase' THEN 'closed' END AS status, ts AS at FROM events),
c AS (SELECT aggregate, max(sequence) AS sequence, arg_max(kind, sequence) AS kind, arg_max_null(status, sequence) AS status, count(*) AS n FROM log WHERE kind <> 'other' GROUP BY aggregate)
"""


def log(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "other").otherwise("upsert")
    return t.events.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("aggregate"), kind.alias("kind"), F.when(F.col("event_type") == "purchase", "closed").alias("status"), F.col("ts").alias("at"))


@query(f"WITH {LOG_SQL} SELECT * FROM c")
def outbox_coalesce(t):
    return outbox.coalesce(log(t))


@query(f"""
WITH {LOG_SQL},
state AS (SELECT c_custkey AS aggregate, CASE WHEN c_custkey % 6 = 0 THEN 1000000 ELSE 5 END AS applied, 'h' || c_custkey % 4 AS old_hash, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'archive' END AS old_partition FROM customer WHERE c_custkey % 5 <> 0),
docs0 AS (SELECT c_custkey AS aggregate, 'h' || c_custkey % 3 AS hash, CASE WHEN c_custkey % 4 < 2 THEN 'active' ELSE 'archive' END AS stored FROM customer WHERE c_custkey % 7 <> 0),
docs AS (SELECT aggregate, hash, CASE WHEN status = 'closed' THEN 'archive' ELSE stored END AS partition FROM docs0 LEFT JOIN c USING (aggregate)),
p AS (SELECT aggregate, sequence, hash, partition, old_partition, CASE WHEN coalesce(applied >= sequence, false) THEN 'superseded' WHEN kind = 'delete' THEN 'delete' WHEN hash IS NULL THEN 'missing'
  WHEN coalesce(hash = old_hash AND partition = old_partition, false) THEN 'unchanged' ELSE 'upsert' END AS action FROM c LEFT JOIN state USING (aggregate) LEFT JOIN docs USING (aggregate))
SELECT aggregate, sequence, action, hash, partition, CASE WHEN action = 'upsert' AND old_partition <> partition THEN old_partition END AS previous FROM p""")
def outbox_plan(t):
    c = F.col("c_custkey")
    half = lambda test: F.when(test, "active").otherwise("archive").alias("partition")
    hashed = lambda k: F.concat(F.lit("h"), (c % k).cast("string")).alias("hash")
    state = t.customer.where(c % 5 != 0).select(c.alias("aggregate"), F.when(c % 6 == 0, 1000000).otherwise(5).alias("sequence"), hashed(4), half(c % 2 == 0))
    docs = t.customer.where(c % 7 != 0).select(c.alias("aggregate"), hashed(3), half(c % 4 < 2))
    return outbox.plan(outbox.coalesce(log(t)), state, docs)


@query(f"WITH {LOG_SQL} SELECT count(*) AS waiting, (epoch(TIMESTAMP '2024-01-31') - min(floor(epoch(\"at\"))))::BIGINT AS oldest_seconds FROM log WHERE sequence % 3 = 1")
def outbox_lag(t):
    return outbox.lag(log(t), log(t).where("sequence % 3 <> 1"), "2024-01-31")


@query("SELECT event_type AS last_error, count(*) AS n FROM events WHERE value > 50 GROUP BY 1 ORDER BY n DESC, last_error LIMIT 3")
def failure_groups(t):
    return t.events.where("value > 50").groupBy(F.col("event_type").alias("last_error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "last_error").limit(3)


@query("SELECT l.page_id FROM pages l WHERE NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_id = l.page_id AND k.page_id % 3 <> 0 AND md5(k.html) = md5(l.html))")
def fetch_known_hash_skip(t):
    of = lambda d: d.select("page_id", F.md5("html").alias("hash"))
    return fetching.unknown_listings(of(t.pages), of(t.pages.where("page_id % 3 <> 0")), ["page_id", "hash"]).select("page_id")


@query("""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 4 > 0 THEN DATE '2024-05-01' + (page_id % 40)::INTEGER END AS modified, CASE WHEN page_id % 5 > 0 THEN DATE '2024-05-01' + (page_id % 40 - CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER END AS seen FROM pages)
SELECT page_id FROM p WHERE modified IS NULL OR seen IS NULL OR modified <> seen OR date_diff('day', modified, DATE '2024-06-03') < 2 OR ('0x' || substr(sha256(url), 1, 8))::BIGINT % 7 = date_diff('day', DATE '1970-01-01', DATE '2024-06-03') % 7""")
def fetch_lastmod_due(t):
    i = F.col("page_id")
    modified = F.when(i % 4 > 0, F.date_add(F.lit("2024-05-01").cast("date"), (i % 40).cast("int")))
    seen = F.when(i % 5 > 0, F.date_add(F.lit("2024-05-01").cast("date"), (i % 40 - F.when(i % 3 == 0, 1).otherwise(0)).cast("int")))
    return t.pages.where(fetching.due(F.col("url"), modified, seen, F.lit("2024-06-03").cast("date"))).select("page_id")


@query("SELECT page_id FROM pages WHERE ('0x' || substr(sha256(url || '@2024-06-03'), 1, 8))::BIGINT % 100 < 2")
def fetch_honesty_probe(t):
    return t.pages.where(fetching.probed(F.col("url"), F.lit("2024-06-03").cast("date"))).select("page_id")


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 11 END NULLS FIRST, page_id) AS pos FROM pages")
def fetch_resume_order(t):
    listed = t.pages.select("page_id", F.col("page_id").alias("listed"))
    history = t.pages.where("page_id % 3 <> 0").select("page_id", (F.col("page_id") % 11).alias("fetched"))
    return fetching.positions(listed.join(history, "page_id", "left"), [F.asc_nulls_first("fetched"), F.asc("listed")]).select("page_id", "pos")


@query("SELECT event_type AS source, count(*) AS probes, count(*) FILTER (value > 98) AS dishonest, count(*) FILTER (value > 98) > count(*) * 0.01 AS distrusted FROM events GROUP BY 1")
def fetch_honesty(t):
    return fetching.distrusted(t.events.select(F.col("event_type").alias("source"), (F.col("value") > 98).alias("dishonest")))


@query("""
SELECT l_orderkey AS run_id, count(*) AS found, count(*) FILTER (l_returnflag = 'N') AS new, count(*) FILTER (l_returnflag = 'R') AS changed, count(*) FILTER (l_returnflag = 'A') AS unchanged,
  0::BIGINT AS rejected FROM lineitem GROUP BY 1""")
def fetch_run_counters(t):
    outcome = F.when(F.col("l_returnflag") == "N", "new").when(F.col("l_returnflag") == "R", "changed").otherwise("unchanged")
    return fetching.counters(t.lineitem.select(F.col("l_orderkey").alias("run_id"), outcome.alias("outcome")))


@query("""
SELECT event_id, CASE WHEN c IN (401, 403) THEN 'blocked' WHEN c IN (404, 410) THEN 'gone' WHEN c = 429 THEN 'rate_limited' WHEN c BETWEEN 500 AND 599 THEN 'server' WHEN c BETWEEN 400 AND 499 THEN 'client' WHEN c BETWEEN 200 AND 399 THEN NULL ELSE 'network' END AS kind,
  CASE WHEN event_id % 11 = 0 THEN 'aborted' WHEN event_id % 7 = 0 THEN 'resumed' WHEN event_id % 5 = 0 THEN 'truncated' ELSE 'complete' END AS completion FROM (SELECT event_id, event_id % 600 AS c FROM events)""")
def fetch_failure_kinds(t):
    i = F.col("event_id")
    return t.events.select("event_id", fetching.failure_kind(i % 600).alias("kind"), fetching.completeness(i % 11 == 0, i % 7 == 0, i % 5 == 0).alias("completion"))


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) <= 2000 THEN html ELSE 'sha256:' || sha256(html) END AS key FROM pages")
def key_bounded(t):
    return t.pages.select("page_id", dedup.bounded(F.col("html")).alias("key"))


@query("""
WITH s AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS ids, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS scope FROM orders GROUP BY o_custkey),
p AS (SELECT id, CASE WHEN id % 5 = 0 THEN ids[:1] ELSE ids END AS approved_ids, CASE WHEN id % 3 = 0 THEN 'a' ELSE scope END AS approved_scope, TIMESTAMP '2024-01-01' + to_days((id % 10)::INTEGER) AS expires FROM s WHERE id % 7 <> 0)
SELECT s.id, CASE WHEN approved_ids IS NULL THEN 'missing' WHEN approved_scope <> scope THEN 'wrong_scope' WHEN approved_ids <> ids THEN 'ids_differ' WHEN expires <= TIMESTAMP '2024-01-05' THEN 'expired' ELSE 'approved' END AS verdict FROM s LEFT JOIN p USING (id)""")
def approval_verdict(t):
    i = F.col("id")
    s = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids")).withColumn("scope", F.when(i % 2 == 0, "a").otherwise("b"))
    a = s.where(i % 7 != 0).select(i.alias("snapshot"), F.when(i % 5 == 0, F.slice("ids", 1, 1)).otherwise(F.col("ids")).alias("ids"), F.when(i % 3 == 0, "a").otherwise(F.col("scope")).alias("scope"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 10).cast("int")).cast("timestamp_ntz").alias("expires"))
    return exporting.approval(s, a, "2024-01-05")


@query("""
SELECT o_orderkey AS id, 'crm:' || o_orderkey || ':create' AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'skip' WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN 'fail' ELSE 'create' END AS plan FROM orders""")
def export_plan(t):
    i = F.col("o_orderkey")
    key = F.concat(F.lit("crm:"), i.cast("string"), F.lit(":create")).alias("key")
    ledger = t.orders.where((i % 3 == 0) | ((i % 3 == 1) & (i % 5 == 0))).select(key, F.when(i % 3 == 0, "confirmed").otherwise("uncertain").alias("state"))
    return exporting.export_plan(t.orders.select(i.alias("id")), ledger, "crm", "create")


QUERY_VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]
COSINE_SQL = f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 15"


@query(f"SELECT * FROM ({COSINE_SQL})")
def knn_cosine_topk(t):
    return ranking.nearest(t.embeddings, QUERY_VECTOR, 15, "vec_id", "embedding")


OTHER_VECTOR = [((i * 23) % 13 - 6) / 6 for i in range(64)]


@query(f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM ({COSINE_SQL})),
b AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM ({COSINE_SQL.replace(str(QUERY_VECTOR), str(OTHER_VECTOR))}))
SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id""")
def rrf_fusion(t):
    near = lambda q: ranking.rank_by(ranking.nearest(t.embeddings, q, 15, "vec_id", "embedding"), [], [F.desc("similarity"), F.asc("vec_id")])
    return ranking.fuse([near(QUERY_VECTOR), near(OTHER_VECTOR)], "vec_id")


@query("""
WITH r AS (SELECT label AS query, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
j AS (SELECT label AS query, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0),
t AS (SELECT query, count(*) AS relevant FROM j GROUP BY query),
p AS (SELECT query, count(*) FILTER (rank <= 20) AS found, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM r JOIN j USING (query, id) GROUP BY query)
SELECT query, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(relevant, 10) + 1)]), 6) AS ndcg FROM t LEFT JOIN p USING (query)""")
def ranking_recall_ndcg(t):
    rows = t.embeddings.select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    return ranking.measures(ranking.rank_by(rows, ["query"], [F.asc("id")]), rows.where("id % 3 = 0"))


@query("SELECT p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median FROM part GROUP BY p_brand")
def marts_median(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.percentile("p_retailprice", 0.5), 6).alias("median"))


@query("SELECT p_size, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part GROUP BY p_size")
def marts_spread(t):
    return t.part.groupBy("p_size").agg(*(F.round(F.percentile("p_retailprice", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)))


@query("""
SELECT 'lineitem' AS name, least(count(*), 1000) AS n, count(*) > 1000 AS truncated FROM lineitem UNION ALL SELECT 'nation', least(count(*), 1000), count(*) > 1000 FROM nation
UNION ALL SELECT 'region', least(count(*), 5), count(*) > 5 FROM region""")
def marts_capped(t):
    def told(name: str, cap: int) -> DataFrame:
        rows, truncated = exporting.capped(getattr(t, name), cap)
        n = rows.agg(F.count("*").alias("n"))
        return n.select(F.lit(name).alias("name"), "n", truncated.scalar().alias("truncated"))

    return told("lineitem", 1000).unionByName(told("nation", 1000)).unionByName(told("region", 5))