"""Text and page functions over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import contracts, html, values
from sluice.operators import exporting, history
from sluice.plans.registry import Tables, query
from sluice.sources import listings

STRIP = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({STRIP.format('html')}) AS n, md5({STRIP.format('html')}) AS digest FROM pages")
def html_strip(t):
    text = html.strip(F.col("html"))
    return t.pages.select("page_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))


@query(f"SELECT page_id, {STRIP.format(chr(39).join(['regexp_extract(html, ', '<title[^>]*>([^<]*)</title>', ', 1)']))} AS title FROM pages")
def html_title(t):
    return t.pages.select("page_id", html.title(F.col("html")).alias("title"))


@query("""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href=["'']([^"'']+)', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || raw AS href, min(pos)::INTEGER AS pos FROM l WHERE raw LIKE '/%' AND raw NOT LIKE '//%' AND regexp_matches(raw, '^/[A-Z]') GROUP BY 1, 2""")
def html_links(t):
    return html.links(t.pages, "page_id", "url", "html", "^/[A-Z]").where(~F.col("href").endswith("://"))


@query("SELECT url AS loc, CASE WHEN page_id % 3 > 0 THEN '2024-01-0' || (page_id % 9 + 1) END AS lastmod FROM pages")
def sitemap_urls(t):
    mod = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<lastmod> 2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit(" </lastmod>"))).otherwise("")
    block = F.concat(F.lit("<url>\n<loc>"), "url", F.lit("</loc>"), mod, F.lit("</url>"))
    maps = t.pages.groupBy(F.floor(F.col("page_id") / 1000).alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(block), "\n"), F.lit("</urlset>")).alias("xml"))
    return html.sitemap(maps, "xml")


@query("SELECT doc_id, (n_chars % 60)::DOUBLE AS min, (n_chars % 60 + doc_id % 9)::DOUBLE AS max FROM documents")
def text_hours(t):
    n = F.col("n_chars") % 60
    written = F.concat(F.lit("Je werkt tussen de "), n.cast("string"), F.lit(" en "), (n + F.col("doc_id") % 9).cast("string"), F.lit(" uur per week"))
    found = values.hours_range(values.hours_text(written))
    return t.documents.select("doc_id", found.alias("h")).select("doc_id", "h.*")


@query("SELECT doc_id, (n_chars % 90 + 10)::DOUBLE AS min, (n_chars % 90 + 20)::DOUBLE AS max, CASE doc_id % 3 WHEN 0 THEN 'uur' WHEN 1 THEN 'dag' ELSE 'maand' END AS unit FROM documents")
def text_rate(t):
    n, unit = F.col("n_chars") % 90 + 10, F.when(F.col("doc_id") % 3 == 0, " per uur").when(F.col("doc_id") % 3 == 1, " per dag").otherwise(" per maand")
    written = F.concat(F.lit("Tarief: 32 tot 40 uur per week, van € "), n.cast("string"), F.lit(",- tot € "), (n + 10).cast("string"), F.lit(",-"), unit)
    return t.documents.select("doc_id", values.rate(written).alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'freelance' WHEN 1 THEN 'detachering' WHEN 2 THEN 'vast' END AS form FROM documents")
def text_contract(t):
    k = F.col("doc_id") % 4
    written = F.when(k == 0, "Freelance opdracht").when(k == 1, "Geen zzp, wel detachering").when(k == 2, "Een vaste baan").otherwise("Iets anders")
    return t.documents.select("doc_id", contracts.contract_in_text(written).alias("form"))


@query("""
SELECT 'text' AS field, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS unknown FROM documents
UNION ALL SELECT 'lang', count(*), count(*) FILTER (lang IS NULL OR trim(lang) IN ('', 'es')) FROM documents
UNION ALL SELECT 'source', count(*), count(*) FILTER (source IS NULL OR trim(source) = '') FROM documents""")
def unknown_inventory(t):
    cells = F.array(*(F.struct(F.lit(c).alias("field"), (values.gap(F.col(c)) | F.coalesce(F.trim(c).isin(no), F.lit(False))).alias("gap")) for c, no in (("text", []), ("lang", ["es"]), ("source", []))))
    return t.documents.select(F.explode(cells).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.count_if("x.gap").alias("unknown"))


@query("""
WITH d AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN n_chars > 500 THEN n_chars END AS n_chars FROM documents)
SELECT source, field, round(avg(filled), 6) AS coverage FROM (SELECT source, 'lang' AS field, (lang IS NOT NULL)::INTEGER AS filled FROM d UNION ALL SELECT source, 'n_chars', (n_chars IS NOT NULL)::INTEGER FROM d) GROUP BY 1, 2""")
def field_coverage(t):
    d = t.documents.select("source", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("n_chars") > 500, F.col("n_chars").cast("string")).alias("n_chars"))
    long = d.unpivot("source", ["lang", "n_chars"], "field", "value")
    return long.groupBy("source", "field").agg(F.round(F.avg(F.col("value").isNotNull().cast("int")), 6).alias("coverage"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 100 >= 85 THEN 'filled' WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang FROM documents")
def enrichment_overlay(t):
    stored = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return t.documents.select("doc_id", values.fill(stored, F.lit("filled"), F.col("doc_id") % 100 / 100, 0.85).alias("lang"))

# Functions over varied wordings: each query deals several cases by the row's number


def dealt(t: Tables, cases: list, kind: str = "string") -> DataFrame:
    """``doc_id, x``: case number ``doc_id`` modulo their count."""
    table = F.array(*(F.lit(c).cast(kind) if not isinstance(c, Column) else c.cast(kind) for c in cases))
    return t.documents.select("doc_id", F.get(table, (F.col("doc_id") % len(cases)).cast("int")).alias("x"))


def expected(column: str, wanted: list, kind: str = "VARCHAR") -> str:
    """The same in SQL: what each case should give."""
    cell = lambda w: "NULL" if w is None else str(w) if isinstance(w, (int, float)) else "'" + w.replace("'", "''") + "'"
    return f"SELECT doc_id, CASE doc_id % {len(wanted)} " + " ".join(f"WHEN {i} THEN {cell(w)}" for i, w in enumerate(wanted)) + f" END::{kind} AS {column} FROM documents"


@query("SELECT 'https://x.nl/sitemap-' || page_id || '.xml' AS loc FROM pages ORDER BY page_id DESC LIMIT 5")
def sitemap_newest_chunks(t):
    chunks = t.pages.select(F.concat(F.lit("https://x.nl/sitemap-"), F.col("page_id").cast("string"), F.lit(".xml")).alias("loc")).unionByName(t.pages.limit(1).select(F.lit("https://x.nl/news.xml").alias("loc")))
    return html.newest_chunks(chunks, "loc", 5)


@query("""
WITH p AS (SELECT page_id AS pos, split_part(url, '?', 1) AS url FROM pages)
SELECT min(pos) AS pos, url FROM p WHERE NOT regexp_matches(url, '/de/') AND NOT regexp_matches(url, '^http://m\\.') GROUP BY url""")
def listing_excluded(t):
    listed = t.pages.select(F.col("page_id").alias("pos"), F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    return listings.excluded(listed, "url", ["/de/", r"^http://m\."]).select("pos", "url")


@query(expected("text", ["a & b", "é < ü", "A&nope;", "&#xZZ; '", "plain", None]))
def html_entities(t):
    rows = dealt(t, ["a &amp; b", "&eacute; &lt; &#252;", "&#x41;&nope;", "&#xZZ; &#39;", "plain", None])
    return rows.select("doc_id", html.decode(F.col("x"), rows).alias("text"))


@query(expected("form", ["interim", None, "freelance", "vast", None, None]))
def contract_agreed(t):
    rows = dealt(t, [F.array(F.lit("TEMPORARY"), F.lit("FULL_TIME")), F.array(F.lit("zzp"), F.lit("vast")), F.array(F.lit(" Contractor"), F.lit("freelance")), F.array(F.lit("Permanent")), F.array().cast("array<string>"), F.lit(None)], "array<string>")
    return rows.select("doc_id", values.agreed_contract(F.col("x")).alias("form"))


@query(expected("place", ["Noord-Holland", "Noord-Brabant", "Friesland", None, "Zuid-Holland", "Utrecht", None]))
def place_province(t):
    rows = dealt(t, ["Provincie: N-Holland", "NB", "Fryslân", "Nergens", "eerst Utrecht, later in Zuid-Holland.", "Regio UTRECHT (stad)", "Gelderlander, ZH"])
    return rows.select("doc_id", F.coalesce(values.province(F.col("x")), values.last_province(F.col("x"))).alias("place"))


@query(expected("found", ["2026-09-21", None, "2024-02-29", None, "2025-12-01", None]))
def text_dutch_date(t):
    rows = dealt(t, ["op 21 september 2026", "30 februari 2026", "uiterlijk 29 Februari 2024!", "1 foo 2026", "start 1 december 2025 of later", None])
    return rows.select("doc_id", values.dutch_date(F.col("x")).cast("string").alias("found"))


@query(expected("closing_ms", [1782943199999, 1767308399999, 1782900000000, 1782907200000, 1782900000000, None], "BIGINT"))
def text_closing_moment(t):
    rows = dealt(t, ["2026-07-01", " 2026-01-01", "2026-07-01T12:00:00", "2026-07-01T12:00:00Z", "2026-07-01T12:00:00+02:00", "soon"])
    return rows.select("doc_id", F.unix_millis(values.closing_moment(F.col("x"))).alias("closing_ms"))


@query(expected("value", ["32 uur", None, "Delft", "€ 80", None]))
def html_labelled_value(t):
    rows = dealt(t, ["<dl><dt>Uren</dt><dd>32 uur.</dd></dl>", "<p>Uren 32</p>", "<table><tr><th>Uren</th><td>Delft , </td></tr></table>", "x\nUren: € 80;\ny", "Uren:\n"])
    lines = html.labelled(F.col("x"))
    plain = F.array_join(F.transform(F.split(lines, "\n"), html.strip), "\n")
    return rows.select("doc_id", html.value_of(plain, "Uren").alias("value"))


@query(expected("body", ["Een baan met genoeg woorden erin", None, None, "Samen bouwen aan een beter spoor", None]))
def html_usable(t):
    rows = dealt(t, ["<nav>Menu</nav><p>Een baan met genoeg woorden erin</p>", "<p>te kort</p>", "We use cookies on this big site okay", "<header>X</header>Samen bouwen <b>aan</b> een beter spoor<script>var x</script>", "driewoordenenverderniets aan elkaar"])
    return rows.select("doc_id", html.usable(F.col("x")).alias("body"))


@query("""
SELECT doc_id, 'Dev ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'uur' ELSE 'maand' END AS salary_unit, doc_id::DOUBLE AS salary_min, (doc_id + 5)::DOUBLE AS salary_max, ['TEMPORARY'] AS employment FROM documents WHERE doc_id % 4 <> 3""")
def html_linked_data(t):
    d, text = F.col("doc_id"), F.col("doc_id").cast("string")
    node = F.concat(
        F.lit('{"@type": "JobPosting", "title": "Dev <i>'), text, F.lit('</i>", "employmentType": "TEMPORARY", "baseSalary": {"value": {"minValue": '), text, F.lit(', "maxValue": '),
        (d + 5).cast("string"), F.lit(', "unitText": "'), F.when(d % 2 == 0, "HOUR").otherwise("month"), F.lit('"}}}'),
    )
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    broken = script(F.lit("{broken"))
    page = F.when(d % 4 == 0, script(node)).when(d % 4 == 1, F.concat(broken, script(F.concat(F.lit('[{"@type": "Org"}, '), node, F.lit("]"))))).when(d % 4 == 2, script(F.concat(F.lit('{"@graph": ['), node, F.lit("]}")))).otherwise(broken)
    nodes = html.linked_data(t.documents.select("doc_id", page.alias("html")), "doc_id", "html")
    return html.posting_facts(nodes).select("doc_id", "title", "salary_unit", "salary_min", "salary_max", "employment")


@query(expected("names", ["Java,Go", "", None, "a,b"]))
def skills_clean(t):
    rows = dealt(t, [F.array(F.lit(" Java"), F.lit("java"), F.lit(""), F.lit("x" * 81), F.lit("Go"), F.lit(None)), F.array().cast("array<string>"), F.lit(None), F.array(F.lit("a"), F.lit("b"), F.lit("A "))], "array<string>")
    return rows.select("doc_id", F.array_join(values.skills(F.col("x")), ",").alias("names"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'keep' WHEN turn % 3 = 1 THEN NULL ELSE role END AS value FROM conversations")
def absent_keeps_cleared_empties(t):
    k = F.col("turn") % 3
    kept = history.keep_or_clear(F.lit("keep"), F.when(k == 2, F.col("role")), k == 1)
    return t.conversations.select("conv_id", "turn", kept.alias("value"))


@query("""
WITH people AS (SELECT doc_id, unnest([{'name': 'A', 'email': NULL, 'phone': NULL, 'role': CASE WHEN doc_id % 2 = 0 THEN 'lead' END}, {'name': 'B', 'email': 'b@x', 'phone': NULL, 'role': NULL}, {'name': 'B', 'email': 'B@X', 'phone': NULL, 'role': 'twin'},
  {'name': NULL, 'email': ' ', 'phone': CASE WHEN doc_id % 3 = 0 THEN '06' END, 'role': NULL}]) AS p, generate_subscripts([1, 2, 3, 4], 1) AS i FROM documents)
SELECT doc_id, coalesce(string_agg(coalesce(p.name, '-'), ',' ORDER BY i) FILTER (i <> 3 AND (p.email = 'b@x' OR p.phone IS NOT NULL OR (p.name IS NOT NULL AND p.role IS NOT NULL))), '') AS names FROM people GROUP BY 1""")
def contacts_kept(t):
    d = F.col("doc_id")
    person = lambda *cells: F.struct(*(F.lit(c).cast("string").alias(n) if not isinstance(c, Column) else c.alias(n) for n, c in zip(("name", "email", "phone", "role"), cells)))
    people = F.array(person("A", None, None, F.when(d % 2 == 0, "lead")), person("B", "b@x", None, None), person("B", "B@X", None, "twin"), person(None, " ", F.when(d % 3 == 0, "06"), None))
    return t.documents.select("doc_id", F.array_join(F.transform(values.contacts(people), lambda p: F.coalesce(p["name"], F.lit("-"))), ",").alias("names"))


@query("""
WITH top AS (SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100), l AS (SELECT list(id ORDER BY r) AS ids FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 100)
SELECT ids, sha256('[' || array_to_string(ids, ',') || ']') AS digest FROM l""")
def selection_snapshot(t):
    return exporting.snapshot(t.documents.withColumnRenamed("doc_id", "id"), [F.desc("n_chars"), F.asc("id")])


#: What a rate looks like, and its least, most and unit.
RATES = [
    ("max tarief van € 95 per uur", None, 95, "uur"), ("uurtarief 80-95", 80, 95, "uur"), ("tarief ingaand 01-02-2026", None, None, None), ("€ 1.234,56 per dag", None, 1234.56, "dag"),
    ("tussen de 60 en 75 euro per uur", 60, 75, "uur"), ("tussen € 700 en € 850 all-in", 700, 850, "uur"), ("tot 36 uur per week", None, None, None), ("salaris € 3.900,- tot € 5.100,-", 3900, 5100, "maand"),
    ("€ 90 - € 80", None, 90, "uur"), ("tarief voor 3 - 5 personen", None, None, None), ("een bonus van € 500 en 20 vrije dagen", None, 500, "uur"), ("vergoeding in overleg", None, None, None), ("€ 64.000 per jaar", None, 64000, None),
]


def _rates_sql() -> str:
    one, two, three = (expected(c, [r[i] for r in RATES], k) for c, i, k in (("min", 1, "DOUBLE"), ("max", 2, "DOUBLE"), ("unit", 3, "VARCHAR")))
    return f"SELECT * FROM ({one}) JOIN ({two}) USING (doc_id) JOIN ({three}) USING (doc_id)"


@query(_rates_sql())
def text_rate_forms(t):
    return dealt(t, [r[0] for r in RATES]).select("doc_id", values.rate(F.col("x")).alias("r")).select("doc_id", "r.*")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Delft' END AS place, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 40)::VARCHAR || ' uur' END AS hours FROM documents""")
def html_label_blocks(t):
    d = F.col("doc_id")
    page = F.concat(F.lit("<b>Plaats:</b><i> "), F.when(d % 2 == 0, "Delft").otherwise(""), F.lit(" </i>"))
    text = F.when(d % 3 == 0, F.concat(F.lit("Inzet: "), (d % 40).cast("string"), F.lit(" uur; start: nu"))).otherwise("Inzet in overleg")
    found = html.label_blocks(page, text, {"place": ("page", r"Plaats:</b>\s*<i>([^<]*)</i>"), "hours": ("description", r"Inzet:\s*([^;]+);")})
    return t.documents.select("doc_id", found["place"].alias("place"), found["hours"].alias("hours"))


HASH_SQL = """
u AS (SELECT doc_id, list_transform(string_split(coalesce(source, '') || '-' || doc_id, ''), lambda c: ord(c)::BIGINT) AS signs FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(3735928559::BIGINT, signs), lambda h, c: ((xor(h, c)::HUGEINT * 2654435761) % 4294967296)::BIGINT) AS a,
  list_reduce(list_prepend(1103547991::BIGINT, signs), lambda h, c: ((xor(h, c)::HUGEINT * 1597334677) % 4294967296)::BIGINT) AS b FROM u),
m AS (SELECT doc_id, b, xor(((xor(a, a >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT, ((xor(b, b >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT) AS a FROM h)
"""


@query(f"""
WITH {HASH_SQL} SELECT doc_id, (xor(((xor(b, b >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT, ((xor(a, a >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT) & 2097151) * 4294967296 + a AS hash FROM m""")
def id_hashes(t):
    return t.documents.select("doc_id", values.id_hash(F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string"))).alias("hash"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Delft' WHEN 1 THEN 'Breda' ELSE NULL END AS place, CASE doc_id % 4 WHEN 0 THEN '36 uur' WHEN 2 THEN '24' ELSE NULL END AS hours, CASE doc_id % 4 WHEN 0 THEN '€ 80' ELSE NULL END AS rate FROM documents""")
def html_between_labels(t):
    rows = dealt(t, ["Locatie: Delft, Uren per week: 36 uur. Tarief: € 80", "x\nLocatie : Breda\nTarief: n.v.t.\nUren per week: -", "Uren per week: 24; Locatie: onbekend", "Sublocatie: Gent"])
    found = html.between_labels(F.col("x"), {"place": "Locatie", "hours": "Uren per week", "rate": "Tarief"})
    return rows.select("doc_id", *(found[c].alias(c) for c in ("place", "hours", "rate")))


@query(expected("body", ["Een rol met genoeg eigen woorden", "De pagina zelf zegt het ook wel", None]))
def html_description(t):
    linked = F.when(F.col("doc_id") % 3 == 0, "<p>Een rol met genoeg eigen woorden</p>").otherwise("kort")
    page = F.when(F.col("doc_id") % 3 < 2, "<nav>Menu menu menu menu menu menu menu</nav><main>De pagina zelf zegt het <b>ook</b> wel</main>").otherwise("<body>zonder hoofddeel maar met genoeg woorden</body>")
    return t.documents.select("doc_id", html.description(linked, page).alias("body"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'new' WHEN turn % 2 = 0 THEN 'stored' END AS informed FROM conversations")
def contacts_carried(t):
    person = lambda email, informed: F.struct(F.col("role").alias("name"), F.lit(email).alias("email"), F.lit(None).cast("string").alias("phone"), informed.cast("string").alias("informed"))
    stored = F.when(F.col("turn") % 2 == 0, F.array(person("a@x", F.lit("other")), person("B@x", F.lit("stored")))).otherwise(F.array(person("a@x", F.lit("other"))))
    people = F.array(person("b@X", F.when(F.col("turn") % 3 == 0, "new")))
    return t.conversations.select("conv_id", "turn", values.carried(people, stored, ("informed",))[0]["informed"].alias("informed"))


#: Sentences and what they say: whether freelance is ruled out, and which forms are offered (freelance, detachering, vast, interim).
SAID = [
    ("Wij werken aan iets moois", False, ""), ("Geen zzp of detachering, wel vast dienstverband", True, "v"), ("Zzp'ers zijn welkom", False, "f"),
    ("Reiskosten gelden niet voor zzp'ers", False, "f"), ("Helaas is deze opdracht niet voor freelancers", True, "f"), ("Geen detachering", False, ""), ("Via detachering", False, "d"),
    ("Interim niet toegestaan", False, ""), ("Voor interim, niet voor zzp", False, "if"), ("Geen budget en freelance kan", False, "f"), ("zzp: nee", True, ""),
    ("Een permanent contract", False, "v"), ("Geen interim, zzp of vast contract mogelijk", True, ""),
]

_SAID_SQL = ", ".join(f"({i}, {out}, {', '.join(str(f in offers) for f in 'fdvi')})" for i, (_, out, offers) in enumerate(SAID))


@query(f"""
WITH s AS (SELECT doc_id, length(unnest(string_split(text, '.'))) % {len(SAID)} AS k FROM documents),
f AS (SELECT doc_id, bool_or(o) AS o, bool_or(f) AS f, bool_or(d) AS d, bool_or(v) AS v, bool_or(i) AS i FROM s JOIN (VALUES {_SAID_SQL}) t(k, o, f, d, v, i) USING (k) GROUP BY 1)
SELECT doc_id, o AS ruled_out, CASE WHEN o AND d THEN 'detachering' WHEN o AND v THEN 'vast' WHEN o AND i THEN 'interim' WHEN o THEN NULL WHEN v AND NOT d AND NOT f THEN 'vast'
  WHEN f AND NOT d AND NOT i THEN 'freelance' WHEN i AND NOT d THEN 'interim' WHEN d THEN 'detachering' END AS form FROM f""")
def contract_of_sentences(t):
    """Every sentence of every text picks one of :data:`SAID` by its length; the forms of a whole text follow from all it says."""
    said = F.array(*(F.lit(sentence) for sentence, _, _ in SAID))
    written = F.array_join(F.transform(F.split("text", r"\."), lambda s: F.get(said, (F.length(s) % len(SAID)).cast("int"))), ". ")
    return t.documents.where("text IS NOT NULL").select("doc_id", contracts.freelance_ruled_out(written).alias("ruled_out"), contracts.contract_in_text(written).alias("form"))


@query("""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS word FROM pages),
b AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, split_part(split_part(url, '?', 1), '#', 1) AS bare, word FROM l WHERE regexp_matches(word, '^[A-Za-z]+$'))
SELECT page_id, word, regexp_replace(bare, '[^/]*$', '') || word AS beside, regexp_replace(bare, '[^/]*/[^/]*$', '') || word AS above, bare || '?p=' || word AS asked, root || '/' || word AS rooted,
  split_part(bare, ':', 1) || '://' || lower(word) || '.nl/' AS elsewhere FROM b""")
def html_resolved_links(t):
    """Words of each page's links as references of several kinds, from its own address."""
    word = F.explode(F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda w: w.rlike("^[A-Za-z]+$"))))
    rows = t.pages.select("page_id", "url", word.alias("word"))
    made = {"beside": F.concat(F.lit("./"), "word"), "above": F.concat(F.lit("x/../../"), "word"), "asked": F.concat(F.lit("?p="), "word"), "rooted": F.concat(F.lit("/a/./../"), "word"), "elsewhere": F.concat(F.lit("//"), F.lower("word"), F.lit(".nl/b/.."))}
    return rows.select("page_id", "word", *(html.resolve(F.col("url"), r).alias(name) for name, r in made.items()))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS word FROM documents),
u AS (SELECT DISTINCT word || CASE WHEN length(word) % 3 = 0 THEN '😀' WHEN length(word) % 3 = 1 THEN '𝒳é' ELSE '' END AS id FROM w),
p AS (SELECT id, list_transform(string_split(id, ''), lambda c: ord(c)::BIGINT) AS points FROM u),
s AS (SELECT id, flatten(list_transform(points, lambda p: CASE WHEN p > 65535 THEN [p, 56320 + (p - 65536) % 1024] ELSE [p] END)) AS signs FROM p),
h AS (SELECT id, list_reduce(list_prepend(3735928559::BIGINT, signs), lambda h, c: ((xor(h, c)::HUGEINT * 2654435761) % 4294967296)::BIGINT) AS a,
  list_reduce(list_prepend(1103547991::BIGINT, signs), lambda h, c: ((xor(h, c)::HUGEINT * 1597334677) % 4294967296)::BIGINT) AS b FROM s),
m AS (SELECT id, b, xor(((xor(a, a >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT, ((xor(b, b >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT) AS a FROM h)
SELECT id, (xor(((xor(b, b >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT, ((xor(a, a >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT) & 2097151) * 4294967296 + a AS hash FROM m""")
def id_hashes_of_words(t):
    """The hash of every different word of the texts, many with characters beyond the basic plane behind them."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)))
    n = F.length("w") % 3
    ids = t.documents.select(word.alias("w")).select(F.concat("w", F.when(n == 0, "😀").when(n == 1, "𝒳é").otherwise("")).alias("id")).distinct()
    return ids.select("id", values.id_hash(F.col("id")).alias("hash"))


@query(f"SELECT page_id, {STRIP.format(chr(39).join(['regexp_extract(html, ', '<title[^>]*>([^<]*)</title>', ', 1)']))} AS name, page_id % 5 AS level FROM pages WHERE page_id % 7 > 0")
def linked_data_nested(t):
    """Each page's own title in a posting, at one of several depths of lists and graphs, behind a broken script and another node."""
    title = html.title(F.col("html"))
    node = F.to_json(F.struct(F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Thing"), F.lit("JobPosting"))).otherwise(F.array(F.lit("JobPosting"))).alias("@type"), title.alias("name"), F.struct((F.col("page_id") % 5).alias("of")).alias("level")))
    shape = F.when(F.col("page_id") % 7 > 0, node).otherwise(F.lit('{"@type": "WebPage", "about": {"@type": "JobPosting"}}'))
    other = '{"@type": "Organization", "name": "x"}'
    for level in range(4):
        wrapped = F.concat(F.lit(f"[{other}, "), shape, F.lit("]")) if level % 2 else F.concat(F.lit('{"@context": "c", "@graph": ['), shape, F.lit("]}"))
        shape = F.when(F.col("page_id") % 5 > level, wrapped).otherwise(shape)
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    page = F.concat(script(F.lit("{broken")), script(F.lit(other)), script(shape), F.col("html"))
    found = html.linked_data(t.pages.select("page_id", page.alias("html")), "page_id", "html")
    return found.select("page_id", F.get_json_object("node", "$.name").alias("name"), F.get_json_object("node", "$.level.of").cast("long").alias("level"))
