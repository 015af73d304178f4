"""What operators see of their own work, and results as JSON that loses no digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import cells
from sluice.operators import context
from sluice.plans.registry import query

#: Customers as operators, their orders as events of an audit, and who is granted what by market segment.
ACTIONS = ("approve_snapshot", "commit_export", "markeer_aanvraag", "login", "logout")
AUDIT_SQL = """
audit AS (SELECT o_orderkey AS id, o_custkey AS actor, CASE WHEN o_totalprice < 150000 THEN 's' ELSE 't' END AS scope,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'approve_snapshot' WHEN '2' THEN 'commit_export' WHEN '3' THEN 'markeer_aanvraag' WHEN '4' THEN 'login' ELSE 'logout' END AS action,
  o_orderstatus AS class, strftime(o_orderdate, '%Y-%m-%d') AS "at" FROM orders)
"""
#: The first event of each actor's scope is a search of theirs, the last one a snapshot; requests name those of the scope "s" under both scopes.
STORED_SQL = """
st AS (SELECT actor, scope, min(id) AS first, max(id) AS last FROM audit GROUP BY 1, 2),
own AS (SELECT a.id, a.actor, a.scope, a."at" FROM audit a JOIN st ON a.actor = st.actor AND a.scope = st.scope AND a.id IN (st.first, st.last))
"""


def audited(t):
    action = F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), F.substring("o_orderpriority", 1, 1).cast("int"))
    scope = F.when(F.col("o_totalprice") < 150000, "s").otherwise("t")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor"), scope.alias("scope"), action.alias("action"), F.col("o_orderstatus").alias("class"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))


def capabilities_of(t):
    """Suppliers' nations as a registry of capabilities, each with a region's permission; customers are granted the permissions of two regions."""
    registry = t.nation.select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "internal-write").otherwise("read").alias("effect"), F.concat(F.lit("for "), F.col("n_name")).alias("outcome"), F.col("n_regionkey").alias("permission"))
    segment = F.length("c_mktsegment") % 5
    granted = t.customer.select(F.col("c_custkey").alias("actor"), F.explode(F.array(segment, segment, (F.col("c_nationkey") % 5).cast("int"))).alias("permission"))
    busy = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    return context.authorised(granted, registry, t.nation.join(busy, "n_nationkey").select(F.col("n_name").alias("id")))


CAPABLE_SQL = """
busy AS (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) % 2 = 0),
g AS (SELECT c_custkey AS actor, length(c_mktsegment) % 5 AS permission FROM customer UNION SELECT c_custkey, c_nationkey % 5 FROM customer),
cap AS (SELECT actor, list({'id': n_name, 'availability': CASE WHEN n_nationkey IN (SELECT s_nationkey FROM busy) THEN 'unavailable' ELSE 'available' END,
  'effect': CASE WHEN n_nationkey % 3 = 0 THEN 'internal-write' ELSE 'read' END, 'outcome': 'for ' || n_name} ORDER BY n_name) AS capabilities FROM g JOIN nation ON n_regionkey = permission GROUP BY 1)
"""


@query(f"""
WITH {AUDIT_SQL}, {STORED_SQL}, {CAPABLE_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY actor, scope ORDER BY "at" DESC, id DESC) AS n FROM audit),
act AS (SELECT actor, scope, list({{'action': action, 'class': class, 'at': "at", 'entity': CASE action WHEN 'approve_snapshot' THEN 'query_snapshot' WHEN 'commit_export' THEN 'export' ELSE 'aanvraag' END}} ORDER BY n) AS activity
  FROM rk WHERE n <= 10 AND action NOT IN ('login', 'logout') GROUP BY 1, 2),
req AS (SELECT c_custkey AS actor, x.scope, first AS search, CASE WHEN c_nationkey % 2 = 0 THEN last END AS snapshot FROM customer CROSS JOIN (VALUES ('s'), ('t')) x(scope) LEFT JOIN st ON actor = c_custkey AND st.scope = 's'),
j AS (SELECT req.actor, req.scope, req.search, req.snapshot, a."at" AS search_at, b."at" AS snapshot_at, coalesce(activity, []) AS activity, coalesce(capabilities, []) AS capabilities,
  CASE WHEN req.search IS NOT NULL AND a.id IS NULL THEN 'search_not_found' WHEN req.snapshot IS NOT NULL AND b.id IS NULL THEN 'snapshot_not_found' END AS error
  FROM req LEFT JOIN own a ON a.id = req.search AND a.actor = req.actor AND a.scope = req.scope LEFT JOIN own b ON b.id = req.snapshot AND b.actor = req.actor AND b.scope = req.scope
  LEFT JOIN act ON act.actor = req.actor AND act.scope = req.scope LEFT JOIN cap ON cap.actor = req.actor)
SELECT actor, scope, error, CASE WHEN error IS NULL THEN len(activity) END AS shown, CASE WHEN error IS NULL THEN len(capabilities) END AS held, CASE WHEN error IS NULL THEN activity[1]."at" END AS observed,
  CASE WHEN error IS NULL THEN CASE WHEN search IS NULL THEN 'not_applicable' ELSE 'present' END END AS search_state,
  CASE WHEN error IS NULL THEN CASE WHEN snapshot IS NULL THEN 'not_applicable' ELSE 'present' END END AS snapshot_state,
  CASE WHEN error IS NULL THEN sha256(to_json({{'name': 'operator-context', 'version': '1.0.0', 'actor': actor, 'scope': scope, 'activity': activity, 'capabilities': capabilities,
    'search': {{'id': search, 'state': CASE WHEN search IS NULL THEN 'not_applicable' ELSE 'present' END, 'at': search_at}},
    'snapshot': {{'id': snapshot, 'state': CASE WHEN snapshot IS NULL THEN 'not_applicable' ELSE 'present' END, 'at': snapshot_at}}}})::VARCHAR) END AS digest
FROM j""")
def operator_contexts(t):
    """The context of every customer under two scopes, one of which doesn't own what is asked for."""
    audit = audited(t)
    ends = audit.groupBy("actor", "scope").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    own = audit.join(ends, ["actor", "scope"]).where(F.col("id").isin(F.col("first"), F.col("last"))).select("id", "actor", "scope", "at")
    named = ends.where("scope = 's'").select("actor", "first", "last")
    customers = t.customer.select(F.col("c_custkey").alias("actor"), "c_nationkey").join(named, "actor", "left")
    asked = customers.select("actor", F.explode(F.array(F.lit("s"), F.lit("t"))).alias("scope"), F.col("first").alias("search"), F.when(F.col("c_nationkey") % 2 == 0, F.col("last")).alias("snapshot"))
    asked = asked.withColumn("request", F.struct("actor", "scope"))
    told = context.operator_context(asked, audit, own, own, capabilities_of(t))
    return told.select("request.actor", "request.scope", "error", F.size("activity").cast("long").alias("shown"), F.size("capabilities").cast("long").alias("held"), "observed", "search_state", "snapshot_state", "digest")


@query("""
SELECT o_orderkey, '{"key":' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '"' || (o_orderkey + 9007199254740992)::VARCHAR || '"' END || ',"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","status":' || to_json(o_orderstatus)::VARCHAR
  || ',"bytes":[' || list_aggregate([ord(x)::VARCHAR for x in string_split(o_orderpriority, '')], 'string_agg', ',') || '],"price":"' || o_totalprice::DECIMAL(18, 2)::VARCHAR || '","lines":'
  || coalesce((SELECT '[' || string_agg('{"line":' || l_linenumber || ',"flags":{"flag":' || to_json(l_returnflag)::VARCHAR || ',"status":' || to_json(l_linestatus)::VARCHAR || '},"shipped":"' || strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00.000Z"}', ',' ORDER BY l_linenumber, l_shipdate, l_returnflag, l_linestatus) || ']' FROM lineitem WHERE l_orderkey = o_orderkey), 'null') || '}' AS json
FROM orders""")
def orders_as_json(t):
    """Whole orders with their lines as JSON: long keys, moments, bytes, decimals, and arrays of structures with maps inside."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("shipped"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    flags = lambda x: F.create_map(F.lit("status"), x["status"], F.lit("flag"), x["flag"])
    ordered = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), flags(x).alias("flags"), x["shipped"].alias("shipped")))
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + (cells.EXACT + 1))
    rows = t.orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", key.alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").cast("binary").alias("bytes"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), ordered.alias("lines")
    )
    of = F.struct(*(c for c in rows.columns if c != "o_orderkey"))
    return rows.select("o_orderkey", of.alias("of")).select("o_orderkey", cells.cell(F.col("of"), rows.select(of.alias("of")).schema["of"].dataType).alias("json"))
