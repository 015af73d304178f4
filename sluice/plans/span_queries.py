"""Histories of few keys with very many rows each, split into spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import spans
from sluice.plans.registry import query

#: Events of one span.
SPAN = 500


def span():
    return F.floor(F.col("event_id") / SPAN)


@query("SELECT event_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def validity_by_spans(t):
    """How long each event is the last of its type: every type is a key of a fifth of all rows."""
    rows = t.events.select("event_id", "event_type", "ts")
    return spans.validity(rows, "event_type", "event_id", "ts", span()).select("event_id", "event_type", "valid_from", "valid_to", "current")


@query("""
WITH o AS (SELECT event_type, event_id, user_id % 2 AS hash, CASE WHEN value IS NULL OR value < 40 THEN NULL WHEN value < 70 THEN 'closed' ELSE 'active' END AS status FROM events),
s AS (SELECT * REPLACE (last_value(status IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status) FROM o),
e AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN hash IS DISTINCT FROM lag(hash) OVER w THEN 'changed' WHEN status IS DISTINCT FROM lag(status) OVER w THEN 'status_changed' END AS event
  FROM s WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, event_id, status, event, count(event) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM e""")
def curate_by_spans(t):
    status = F.when(F.col("value").isNull() | (F.col("value") < 40), None).when(F.col("value") < 70, "closed").otherwise("active")
    seen = t.events.select("event_type", "event_id", (F.col("user_id") % 2).alias("hash"), status.alias("status"))
    return spans.curate(seen, "event_type", "event_id", span()).select("event_type", "event_id", "status", "event", "version")


@query("""
WITH p AS (SELECT event_type, event_id, user_id % 9 = 0 AS seen, user_id % 4 > 0 AS complete FROM events),
s AS (SELECT *, sum(seen::INTEGER) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM p),
m AS (SELECT *, least(sum((NOT seen AND complete)::INTEGER) OVER (PARTITION BY event_type, spell ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4)::BIGINT AS missed FROM s)
SELECT event_type, event_id, missed, CASE WHEN missed >= 3 THEN 'stale' ELSE 'active' END AS status FROM m""")
def missed_polls_by_spans(t):
    polls = t.events.select("event_type", "event_id", (F.col("user_id") % 9 == 0).alias("seen"), (F.col("user_id") % 4 > 0).alias("complete"))
    return spans.missed_polls(polls, "event_type", "event_id", span()).select("event_type", "event_id", F.col("missed").cast("long").alias("missed"), "status")
