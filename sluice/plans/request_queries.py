"""Requests against attestations, revisions, imports and ad-hoc questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import assessment, exporting, history
from sluice.plans.registry import Tables, query
from sluice.sources import stores

#: Orders as requests for their parts, and what is attested of them; where they differ follows from the order's number.
REQUESTS_SQL = """
l AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 1) AS one, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS k, one FROM orders JOIN l ON o_orderkey = k),
f AS (SELECT k AS request, 'UPSTREAM_ATTESTATION_UNAVAILABLE' AS code FROM r WHERE k % 7 = 0
  UNION ALL SELECT k, 'QUERY_DIGEST_MISMATCH' FROM r WHERE k % 7 > 0 AND k % 6 = 0
  UNION ALL SELECT k, 'SELECTION_DIGEST_MISMATCH' FROM r WHERE k % 7 > 0 AND (k % 6 = 0 OR k % 11 = 0 OR (k % 5 = 0 AND one))
  UNION ALL SELECT k, 'UPSTREAM_SEARCH_INCOMPLETE' FROM r WHERE k % 7 > 0 AND k % 9 = 0
  UNION ALL SELECT k, 'CLAIM_ATTESTATION_MISMATCH' FROM r WHERE k % 7 > 0 AND (k % 8 = 0 OR k % 10 = 0) AND one)
"""


def requested(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k, line = F.col("request"), F.col("l_linenumber")
    lines = t.lineitem.withColumnRenamed("l_orderkey", "request")
    ids = lines.groupBy("request").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("id"))).alias("of"))
    shape = lambda a, b: F.format_string(f'{{"{a}": %s, "{b}": %s}}', "x", "y")
    orders = t.orders.select(F.col("o_orderkey").alias("request"), F.to_json(F.struct("o_orderpriority")).alias("x"), F.col("o_custkey").cast("string").alias("y"))
    rows = orders.join(ids, "request")
    # The same structure written in another order of keys has the same digest.
    digest = assessment.query_digest(shape("p", "c"))
    again = assessment.query_digest(F.format_string('{ "c":%s,"p" : %s}', "y", "x"))
    plain = lambda of: F.transform(of, lambda p: p["id"])
    asked = F.when(k % 5 == 0, F.filter("of", lambda p: p["line"] != 1)).otherwise(F.col("of"))
    own = rows.select("request", digest.alias("query_digest"), plain(asked).alias("ids"))
    own = own.withColumn("selection_digest", F.when(k % 11 == 0, "sha256:0").otherwise(assessment.selection_digest(F.col("query_digest"), F.col("ids"))))
    attested = rows.where(k % 7 > 0).select("request", F.when(k % 6 == 0, "sha256:1").otherwise(again).alias("query_digest"), F.reverse(plain(F.col("of"))).alias("ids"), F.when(k % 9 == 0, "partial").otherwise("complete").alias("search"))
    cited = F.array(F.col("l_suppkey").cast("string"), F.lit("b"), F.lit("a"))
    claims = lines.select("request", F.col("l_partkey").alias("item"), (line % 3).cast("string").alias("field"), F.lit("known").alias("status"), F.col("l_linestatus").alias("value"), cited.alias("cited"), "l_linenumber")
    changed = claims.withColumn("value", F.when((k % 8 == 0) & (line == 1), "x").otherwise(F.col("value"))).withColumn("cited", F.reverse("cited"))
    twice = changed.where((k % 10 == 0) & (line == 1))
    return own, claims.drop("l_linenumber"), attested, changed.unionByName(twice).drop("l_linenumber")


@query(f"WITH {REQUESTS_SQL} SELECT request, code FROM f")
def assess_requests(t):
    return assessment.request_findings(*requested(t))


@query(f"""
WITH {REQUESTS_SQL} SELECT r.k AS request, CASE WHEN r.k % 7 = 0 THEN 'blocked-upstream' WHEN r.k % 5 = 0 AND l.one AND l.n = c.ones THEN 'insufficient-evidence' WHEN r.k IN (SELECT request FROM f) THEN 'needs-review' ELSE 'passed' END AS status
FROM r JOIN l ON r.k = l.k JOIN (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber = 1) AS ones FROM lineitem GROUP BY 1) c ON c.k = r.k""")
def assess_request_status(t):
    return assessment.assessed(*requested(t))


#: What is stored of orders, and two writers of each; the second one sees what the first has done if the number is odd.
REVISIONS_SQL = """
s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 + 1 END AS rev, o_orderkey % 7 = 0 AS deleted, o_orderstatus AS value FROM orders),
a AS (SELECT *, o1 AS e1, CASE WHEN o1 IS NOT DISTINCT FROM rev THEN true ELSE false END AS ok1 FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 9 ELSE rev END AS o1 FROM s)),
b AS (SELECT *, CASE WHEN ok1 THEN coalesce(rev, 0) + 1 ELSE rev END AS rev1 FROM a),
c AS (SELECT *, CASE WHEN k % 5 = 0 THEN rev1 ELSE rev END AS e2 FROM b),
d AS (SELECT *, e2 IS NOT DISTINCT FROM rev1 AS ok2 FROM c),
e AS (SELECT *, CASE WHEN ok2 THEN coalesce(rev1, 0) + 1 ELSE rev1 END AS rev2 FROM d)
"""


def written(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 4 + 1).alias("revision"), (F.col("o_orderkey") % 7 == 0).alias("deleted"), F.col("o_orderstatus").alias("value"))
    first = F.when(k % 2 == 0, F.lit(9).cast("long")).otherwise(F.col("revision"))
    after = F.when(first.eqNullSafe(F.col("revision")), F.coalesce("revision", F.lit(0).cast("long")) + 1).otherwise(F.col("revision"))
    second = F.when(k % 5 == 0, after).otherwise(F.col("revision"))
    one = rows.select("k", F.lit(1).alias("turn"), first.alias("expected"), F.lit(False).alias("deleted"), F.lit("first").alias("value"))
    two = rows.select("k", F.lit(2).alias("turn"), second.alias("expected"), (k % 4 == 0).alias("deleted"), F.lit("second").alias("value"))
    return rows.where("revision IS NOT NULL"), two.unionByName(one)


@query(f"""
WITH {REVISIONS_SQL} SELECT k, 1 AS turn, CASE WHEN ok1 THEN 'applied' ELSE 'conflict' END AS outcome, rev1 AS revision FROM e UNION ALL SELECT k, 2, CASE WHEN ok2 THEN 'applied' ELSE 'conflict' END, rev2 FROM e""")
def revision_outcomes(t):
    return history.write_revisions(*written(t), ["k"], "turn")[1]


@query(f"""
WITH {REVISIONS_SQL} SELECT k, rev2 AS revision, CASE WHEN ok2 THEN k % 4 = 0 WHEN ok1 THEN false ELSE deleted END AS deleted, CASE WHEN ok2 THEN 'second' WHEN ok1 THEN 'first' ELSE value END AS value FROM e WHERE rev2 IS NOT NULL""")
def revision_rows(t):
    return history.write_revisions(*written(t), ["k"], "turn")[0]


STORED_SQL = """
w AS (SELECT o_orderstatus AS platform, o_orderkey AS k, o_totalprice AS price FROM orders),
h AS (SELECT platform, k, CASE WHEN k % 17 = 0 THEN price + 1 ELSE price END AS price FROM w WHERE k % 13 > 0 UNION ALL SELECT platform, k, CASE WHEN k % 17 = 0 THEN price + 1 ELSE price END FROM w WHERE k % 19 = 0 AND k % 13 > 0
  UNION ALL SELECT platform, -k, price FROM w WHERE k % 23 = 0)
"""


def imported(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as an import's source, and what is stored of them: some lost, some changed, some twice, some that nobody sent."""
    k = F.col("k")
    rows = t.orders.select(F.col("o_orderstatus").alias("platform"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    kept = rows.where(k % 13 > 0).withColumn("price", F.when(k % 17 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return rows, kept.unionByName(kept.where(k % 19 == 0)).unionByName(rows.where(k % 23 == 0).withColumn("k", -k)).repartition(8, "price")


@query(f"""
WITH {STORED_SQL}, a AS (SELECT platform, k, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT platform, k, count(*) AS m FROM h GROUP BY ALL),
j AS (SELECT coalesce(a.platform, b.platform) AS platform, n, m FROM a FULL JOIN b ON a.platform = b.platform AND a.k = b.k),
g AS (SELECT platform, 0 AS is_total, n, m FROM j UNION ALL SELECT NULL, 1, n, m FROM j)
SELECT platform, is_total, count(n) AS selected, coalesce(sum(m), 0)::BIGINT AS records, count(*) FILTER (n IS NOT NULL AND m IS NOT NULL) AS matched, count(*) FILTER (m IS NULL) AS missing,
  count(*) FILTER (n IS NULL) AS extra, coalesce(sum(m - 1), 0)::BIGINT AS duplicates FROM g GROUP BY 1, 2""")
def import_metrics(t):
    found = stores.import_metrics(*imported(t), "platform", "k")
    return found.withColumn("is_total", F.col("is_total").cast("int"))


@query(f"""
WITH {STORED_SQL}, a AS (SELECT k, count(*) AS n, max(price) AS p FROM w GROUP BY 1), b AS (SELECT k, count(*) AS m, max(price) AS q FROM h GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN m IS NULL THEN 'lost' WHEN n IS NULL THEN 'extra' WHEN p <> q THEN 'changed' ELSE 'repeated' END AS problem FROM a FULL JOIN b ON a.k = b.k WHERE m IS NULL OR n IS NULL OR p <> q OR n <> m""")
def import_readback(t):
    return stores.readback(*imported(t), ["k"], ["platform", "price"])


@query("""
WITH s AS (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1)
SELECT 'whole' AS asked, count(*)::INTEGER AS rows, false AS truncated, sum(n)::BIGINT AS n, NULL::VARCHAR AS reason FROM s
UNION ALL SELECT 'cut', 3, true, (SELECT sum(n)::BIGINT FROM (SELECT n FROM s ORDER BY n DESC, priority LIMIT 3)), NULL UNION ALL SELECT 'wrong', 0, false, NULL, 'error'""")
def adhoc_answers(t):
    """Three questions about the orders: one inside its cap, one that is cut, and one that names what isn't there."""
    t.orders.createOrReplaceTempView("asked_orders")
    sql = "SELECT o_orderpriority AS priority, count(*) AS n FROM asked_orders GROUP BY 1 ORDER BY n DESC, priority"
    answers = {"whole": exporting.ask(t.spark, sql, 100, 600), "cut": exporting.ask(t.spark, sql, 3, 600), "wrong": exporting.ask(t.spark, "SELECT missing FROM asked_orders", 3, 600)}
    rows = [(name, len(a.rows), a.truncated, sum(r["n"] for r in a.rows) if a.rows else None, "error" if a.reason else None) for name, a in answers.items()]
    return t.spark.createDataFrame(rows, "asked string, rows int, truncated boolean, n long, reason string")
