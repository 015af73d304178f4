"""Search queries over ``documents`` and its stand-ins."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import search
from sluice.plans.registry import Tables, query

NOW = datetime(2024, 7, 1, 12, 3, 20, tzinfo=timezone.utc)

#: documents as search documents: dates and ranges are derived from the row's numbers.
DOCS_SQL = """
SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text, d.source, d.lang,
       CASE WHEN l.toxic = 1 THEN 'closed' WHEN l.quality = 0 THEN 'stale' WHEN l.quality = 1 THEN 'active' ELSE 'unknown' END AS status,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'vast' ELSE 'freelance' END AS contract,
       list_filter(string_split('a,b,c', ','), lambda x: (x = 'a' AND d.doc_id % 2 = 0) OR (x = 'b' AND d.doc_id % 3 = 0) OR (x = 'c' AND d.doc_id % 5 = 0)) AS skills,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (d.n_chars % 90)::DOUBLE END AS rate_min,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE (d.n_chars % 90 + d.doc_id % 20)::DOUBLE END AS rate_max,
       TIMESTAMP '2024-01-01' + to_hours(d.doc_id % 4800) AS posted,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-06-20' + to_minutes((d.doc_id * 37) % 40000) END AS closing,
       TIMESTAMP '2024-06-01' + to_hours((d.doc_id * 5) % 720) AS last_seen
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
"""


def docs(t: Tables) -> DataFrame:
    labels = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    i, n = F.col("doc_id"), F.col("n_chars")
    status = F.when(F.col("toxic") == 1, "closed").when(F.col("quality") == 0, "stale").when(F.col("quality") == 1, "active").otherwise("unknown")
    skill = lambda name, k: F.when(i % k == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    at = lambda start, seconds: (F.lit(start).cast("timestamp").cast("long") + seconds).cast("timestamp")
    return t.documents.join(labels, "doc_id", "left").select(
        i.alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", "source", "lang", status.alias("status"),
        F.when(i % 7 == 0, None).when(i % 2 == 0, "vast").otherwise("freelance").alias("contract"),
        F.concat(skill("a", 2), skill("b", 3), skill("c", 5)).alias("skills"),
        F.when(i % 11 != 0, (n % 90).cast("double")).alias("rate_min"),
        F.when(i % 13 != 0, (n % 90 + i % 20).cast("double")).alias("rate_max"),
        at("2024-01-01", (i % 4800) * 3600).alias("posted"),
        F.when(i % 5 != 0, at("2024-06-20", (i * 37) % 40000 * 60)).alias("closing"),
        at("2024-06-01", (i * 5) % 720 * 3600).alias("last_seen"),
    )


def over(sql: str) -> str:
    return f"WITH d AS ({DOCS_SQL}) {sql}"


def has(words: str, scope: Column | None = None) -> Column:
    return search.term(words, search.haystack("title", "text") if scope is None else scope)


LIKE = "contains(lower(concat_ws(' ', title, text)), '{}')"
QUERY_SQL = f"({LIKE.format('the')} OR {LIKE.format('and the')}) AND NOT {LIKE.format('und ')}"


def matched(t: Tables) -> DataFrame:
    scope = search.haystack("title", "text")
    return docs(t).where(search.matches(scope, lambda h: (search.term("the", h) | search.term("and the", h)) & ~search.term("und ", h)))


@query(over(f"SELECT id, lang, status FROM d WHERE {QUERY_SQL}"))
def search_boolean_and_or_not(t):
    return matched(t).select("id", "lang", "status")


@query(over(f"SELECT id FROM d WHERE {LIKE.format('of the')} AND {LIKE.format('with')}"))
def search_phrase(t):
    return docs(t).where(search.matches(search.haystack("title", "text"), lambda h: search.term("of the", h) & search.term("with", h))).select("id")


@query(over("SELECT id, title FROM d WHERE contains(lower(title), 'the') AND NOT contains(lower(title), 'and')"))
def search_title_scope(t):
    title = search.haystack("title")
    return docs(t).where(has("the", title) & ~has("and", title)).select("id", "title")


@query(over("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM d"))
def search_browse(t):
    return docs(t).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(over("SELECT id FROM d WHERE source IN ('src0', 'src3') AND status IN ('active', 'unknown') AND lang IN ('en', 'fr') AND coalesce(contract, '') IN ('', 'vast')"))
def search_filters_in(t):
    f = search.Filters(sources=["src0", "src3"], statuses=["active", "unknown"], langs=["en", "fr"], contracts=["", "vast"])
    return docs(t).where(search.predicate(f, NOW)).select("id")


@query(over("SELECT id, rate_min, rate_max FROM d WHERE rate_max >= 30 AND rate_min <= 50"))
def search_filters_overlap(t):
    return docs(t).where(search.predicate(search.Filters(rate=(30, 50)), NOW)).select("id", "rate_min", "rate_max")


@query(over("SELECT id FROM d WHERE posted >= TIMESTAMP '2024-02-10' AND posted < TIMESTAMP '2024-03-02'"))
def search_filters_posted(t):
    return docs(t).where(search.predicate(search.Filters(posted=("2024-02-10", "2024-03-01")), NOW)).select("id")


@query(over("SELECT id FROM d WHERE list_contains(skills, 'a') AND list_contains(skills, 'c')"))
def search_filters_skills_all(t):
    return docs(t).where(search.predicate(search.Filters(skills=["a", "c"]), NOW)).select("id")


@query(over("SELECT id FROM d WHERE epoch(last_seen)::BIGINT >= epoch(TIMESTAMP '2024-07-01 12:03:20')::BIGINT - 7 * 86400"))
def search_freshness(t):
    return docs(t).where(search.predicate(search.Filters(fresh_days=7), NOW)).select("id")


FACETS_SQL = over(f"""
, m AS (SELECT * FROM d WHERE {QUERY_SQL}),
p AS (SELECT 'source' AS field, source AS value FROM m UNION ALL SELECT 'lang', lang FROM m UNION ALL SELECT 'status', status FROM m
      UNION ALL SELECT 'contract', coalesce(contract, 'unknown') FROM m UNION ALL SELECT 'skills', unnest(skills) FROM m),
n AS (SELECT field, value, count(*) AS n FROM p WHERE value <> '' GROUP BY field, value)
""")
FACET_FIELDS = ["source", "lang", "status", "contract"]


@query(FACETS_SQL + "SELECT * FROM n")
def search_facets(t):
    return search.facets(matched(t), FACET_FIELDS, "skills")


@query(FACETS_SQL + "SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM n) WHERE r <= CASE field WHEN 'source' THEN 5 WHEN 'skills' THEN 2 ELSE 100 END")
def search_facets_capped(t):
    return search.facets(matched(t), FACET_FIELDS, "skills", {"source": 5, "skills": 2})


PARTITION_SQL = "CASE WHEN status IN ('closed', 'stale') OR coalesce(epoch(closing)::BIGINT < epoch(TIMESTAMP '2024-07-01 12:03:20')::BIGINT, false) THEN 'archive' ELSE 'active' END"


@query(over(f", p AS (SELECT *, {PARTITION_SQL} AS partition FROM d WHERE {QUERY_SQL}) SELECT count(*) FILTER (partition = 'active' AND coalesce(closing > TIMESTAMP '2024-07-01 12:00:00', true)) AS total, count(*) FILTER (partition = 'archive') AS archive_total FROM p"))
def search_total_and_archive(t):
    return search.totals(matched(t).withColumn("partition", search.partition(NOW)), NOW)


for _mode, _sql in {
    "newest": "posted DESC NULLS LAST", "oldest": "posted ASC NULLS LAST", "rate-high": "rate_max DESC NULLS LAST", "rate-low": "rate_min ASC NULLS LAST",
    "closing-soon": "closing ASC NULLS LAST", "title-asc": "title ASC NULLS LAST", "relevance": "1",
}.items():

    def _sorted(t, mode=_mode):
        return search.page(matched(t), mode, 20, 25).select("id", "title")

    _sorted.__name__ = f"search_sort_{_mode.replace('-', '_')}"
    query(over(f"SELECT id, title FROM (SELECT * FROM d WHERE {QUERY_SQL} ORDER BY {_sql if _sql != '1' else 'id'}, id LIMIT 25 OFFSET 20)"))(_sorted)


@query(over(f"SELECT id FROM (SELECT * FROM d WHERE {LIKE.format('e')} ORDER BY id LIMIT 40 OFFSET 960)"))
def search_page_window(t):
    return search.page(docs(t).where(has("e")), "relevance", 960, 100).select("id")


@query(over("SELECT id, (CASE WHEN contains(lower(title), 'the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(array_to_string(skills, ' ')), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END)::INTEGER AS score FROM d"))
def search_relevance(t):
    d = docs(t)
    return d.select("id", search.relevance(["the"], d["title"], F.array_join("skills", " "), d["text"]).cast("int").alias("score"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey < 2000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def keyset_page_desc(t):
    return search.after(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], [datetime(1996, 1, 1), 2000], 50)
