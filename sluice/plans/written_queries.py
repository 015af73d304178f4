"""Text and page functions over what the texts and pages themselves say: the cases come from their words and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import html, values
from sluice.plans.registry import query

#: Letters and marks and the entities that stand for them.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;"), ('"', "&quot;"), ("ß", "&szlig;"))


@query("SELECT page_id, length(html) AS n, md5(html) AS digest FROM pages")
def pages_decoded(t):
    """Pages written with entities and decoded again."""
    coded = F.col("html")
    for sign, entity in ENTITIES:
        coded = F.replace(coded, F.lit(sign), F.lit(entity))
    rows = t.pages.select("page_id", coded.alias("coded"))
    plain = rows.select("page_id", html.decode(F.col("coded"), rows).alias("x"))
    return plain.select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


_REMOVED = "html"
for _tag in ("nav", "header", "footer", "aside", "script", "style", "form"):
    _REMOVED = rf"regexp_replace({_REMOVED}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"


@query(rf"""
WITH b AS (SELECT page_id, page_id % 7 AS k, trim(regexp_replace(regexp_replace({_REMOVED}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages),
c AS (SELECT page_id, CASE WHEN k = 0 THEN 'We use ' || body || ' cookies' WHEN k = 1 THEN substr(body, 1, 30) ELSE body END AS body, k FROM b)
SELECT page_id, md5(trim(body)) AS digest FROM c WHERE k > 0 AND length(trim(body)) >= 24 AND len(string_split(trim(body), ' ')) >= 4""")
def pages_usable(t):
    """Whole pages as descriptions, some of them notices about cookies, some cut short."""
    k = F.col("page_id") % 7
    plain = html.strip(F.regexp_replace("html", r"(?is)<(nav|header|footer|aside|script|style|form)\b.*?</\1>", " "))
    written = F.when(k == 0, F.concat(F.lit("We use "), plain, F.lit(" cookies"))).when(k == 1, F.substring(plain, 1, 30)).otherwise(F.col("html"))
    body = html.usable(written)
    return t.pages.select("page_id", F.md5(body).alias("digest")).where("digest IS NOT NULL")


def digitless() -> Column:
    """The whole text without digits and marks of money, so that only what is written behind it has amounts."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9€]", "")


#: Lengths of a text's first and last words, a lower and a higher amount.
AMOUNTS_SQL = """
a AS (SELECT doc_id, length(regexp_extract(text, '^\\s*(\\S+)', 1)) % 60 + 40 AS low, length(regexp_extract(text, '(\\S+)\\s*$', 1)) % 30 + 1 AS more, length(text) % 7 AS k FROM documents WHERE text IS NOT NULL)
""".replace("\\\\", "\\")


def amounts() -> tuple[Column, Column, Column]:
    low = F.length(F.regexp_extract("text", r"^\s*(\S+)", 1)) % 60 + 40
    more = F.length(F.regexp_extract("text", r"(\S+)\s*$", 1)) % 30 + 1
    return low, low + more, F.length("text") % 7


@query(f"""
WITH {AMOUNTS_SQL} SELECT doc_id, CASE WHEN k IN (0, 1, 2, 5) THEN low::DOUBLE END AS min, CASE WHEN k IN (0, 1, 2, 5) THEN (low + more)::DOUBLE WHEN k IN (3, 4) THEN low::DOUBLE END AS max,
  CASE WHEN k IN (0, 1, 3, 5) THEN 'uur' WHEN k = 2 THEN 'dag' WHEN k = 4 THEN 'maand' END AS unit FROM a""")
def texts_rates(t):
    """A rate behind every text, in one of several wordings by the text's length."""
    low, high, k = amounts()
    a, b = low.cast("string"), high.cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    written = (
        F.when(k == 0, said(" van € ", a, ",- tot € ", b, ",- per uur")).when(k == 1, said(" tussen de ", a, " en ", b, " euro per uur")).when(k == 2, said(" € ", a, " - € ", b, " per dag"))
        .when(k == 3, said(" max tarief van € ", a, " per uur")).when(k == 4, said(" een vergoeding van € ", a, " per maand")).when(k == 5, said(" uurtarief ", a, "-", b)).otherwise(said(" voor ", a, " - ", b, " personen"))
    )
    rate = values.rate(F.concat(F.regexp_replace(digitless(), r"(?i)[/]|per|tarief|salaris|all|excl|ex |inclusief", ""), written))
    return t.documents.where("text IS NOT NULL").select("doc_id", rate.alias("r")).select("doc_id", "r.*")


@query(f"""
WITH {AMOUNTS_SQL} SELECT doc_id, CASE WHEN k < 5 THEN low::DOUBLE END AS min, CASE k WHEN 0 THEN (low + more)::DOUBLE WHEN 1 THEN (low + more)::DOUBLE WHEN 2 THEN low::DOUBLE WHEN 3 THEN low + 0.5 WHEN 4 THEN low::DOUBLE END AS max FROM a""")
def texts_hours(t):
    """Hours behind every text, in one of several wordings by the text's length."""
    low, high, k = amounts()
    a, b = low.cast("string"), high.cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    written = (
        F.when(k == 0, said(" tussen de ", a, " en ", b, " uur per week")).when(k == 1, said(" ", a, " – ", b, " hours")).when(k == 2, said(" ", a, "u p/w")).when(k == 3, said(" ", a, "-", a, ",5 uur"))
        .when(k == 4, said(" ", a, " hrs")).when(k == 5, said(" ", b, "-", a, " uur")).otherwise(said(" ", a, " euro"))
    )
    found = values.hours_range(values.hours_text(F.concat(digitless(), written)))
    return t.documents.where("text IS NOT NULL").select("doc_id", found.alias("h")).select("doc_id", "h.*")


MONTHS_SQL = ", ".join(f"'{m}'" for m in values.MONTHS)


@query(f"""
WITH {AMOUNTS_SQL}, p AS (SELECT doc_id, (low * 7 + more) % 31 + 1 AS day, (low + k) % 12 + 1 AS month, 2020 + more % 8 AS year FROM a)
SELECT doc_id, try_strptime(year || '-' || month || '-' || day, '%Y-%m-%d')::DATE AS day FROM p""")
def texts_dates(t):
    """A Dutch date behind every text; some the calendar hasn't got."""
    low, high, k = amounts()
    more = high - low
    month = F.get(F.array(*map(F.lit, values.MONTHS)), ((low + k) % 12).cast("int"))
    written = F.concat(digitless(), F.lit(" op "), ((low * 7 + more) % 31 + 1).cast("string"), F.lit(" "), F.initcap(month), F.lit(" "), (2020 + more % 8).cast("string"), F.lit("!"))
    return t.documents.where("text IS NOT NULL").select("doc_id", values.dutch_date(written).alias("day"))


PLACES = ("Utrecht", "Zuid-Holland", "noord brabant", "Fryslân", "Nergenshuizen", "LIMBURG")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents),
n AS (SELECT doc_id, i, CASE length(s) % 6 WHEN 0 THEN 'Utrecht' WHEN 1 THEN 'Zuid-Holland' WHEN 2 THEN 'Noord-Brabant' WHEN 3 THEN 'Friesland' WHEN 5 THEN 'Limburg' END AS place FROM s)
SELECT doc_id, arg_max(place, i) AS place FROM n GROUP BY 1""")
def texts_last_place(t):
    """A place behind each sentence of each text, by its length; the last province named counts."""
    named = F.transform(F.split("text", r"\."), lambda s: F.concat(s, F.lit(" in "), F.get(F.array(*map(F.lit, PLACES)), (F.length(s) % len(PLACES)).cast("int"))))
    return t.documents.where("text IS NOT NULL").select("doc_id", values.last_province(F.array_join(named, ". ")).alias("place"))


TOKENS = ("zzp", "Freelance", "interim", "FULL_TIME", "vast", "Temporary", " contractor ")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, '.')[1:3]) AS s FROM documents),
f AS (SELECT doc_id, CASE length(s) % 7 WHEN 0 THEN 'freelance' WHEN 1 THEN 'freelance' WHEN 2 THEN 'interim' WHEN 4 THEN 'vast' WHEN 5 THEN 'interim' WHEN 6 THEN 'freelance' END AS form FROM s)
SELECT doc_id, CASE WHEN count(DISTINCT form) = 1 THEN max(form) END AS form FROM f GROUP BY 1""")
def texts_agreed_contract(t):
    """The first three sentences of each text as tokens, by their lengths; the form they agree on."""
    tokens = F.transform(F.slice(F.split("text", r"\."), 1, 3), lambda s: F.get(F.array(*map(F.lit, TOKENS)), (F.length(s) % len(TOKENS)).cast("int")))
    return t.documents.where("text IS NOT NULL").select("doc_id", values.agreed_contract(tokens).alias("form"))


@query(r"""
WITH w AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages),
u AS (SELECT page_id, unnest(string_split(title || ' ' || lower(title), ' ')) AS word, generate_subscripts(string_split(title || ' ' || lower(title), ' '), 1) AS i FROM w),
f AS (SELECT page_id, lower(word) AS low, arg_min(word, i) AS word, min(i) AS i FROM u WHERE word <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM f)
SELECT page_id, string_agg(word, ',' ORDER BY i) AS names FROM r WHERE r <= 40 GROUP BY 1""")
def titles_skills(t):
    """The words of each page's title, written twice, as a list of skills: the first of each whatever its case."""
    title = html.title(F.col("html"))
    words = F.split(F.concat_ws(" ", title, F.lower(title)), " ")
    return t.pages.select("page_id", F.array_join(values.skills(words), ",").alias("names")).where("names <> ''")


@query(r"""
WITH w AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN title || '' ELSE NULL END AS stands FROM w""")
def titles_stand_in(t):
    """Descriptions that are the title's stand-in are told from others."""
    title, key = html.title(F.col("html")), F.col("page_id").cast("string")
    stand_in = values.title_fallback(title, F.lit("p"), key)
    text = F.when(F.col("page_id") % 3 == 0, F.concat(title, F.lit(" (p/"), key, F.lit(")"))).otherwise(F.concat(title, F.lit(" (p/"), key, F.lit("x)")))
    return t.pages.select("page_id", F.when(text == stand_in, title).alias("stands"))


_LIST_SQL = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH w AS (SELECT page_id, {_LIST_SQL} AS title, html FROM pages)
SELECT page_id, nullif(regexp_replace(title, '[\s.,;]+$', ''), '') AS listed, nullif(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[\s.,;]+$', ''), '') AS tabled FROM w JOIN pages USING (page_id)""")
def pages_labelled(t):
    """Each page's title in a definition list and its host in a table, set before the page itself."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    made = F.concat(F.lit("<dl><dt>Functie</dt> <dd><b>"), html.title(F.col("html")), F.lit("</b>.</dd></dl><table><tr><th>Waar</th><td>"), host, F.lit(" ,</td></tr></table>"), "html")
    plain = F.array_join(F.transform(F.split(html.labelled(made), "\n"), html.strip), "\n")
    return t.pages.select("page_id", html.value_of(plain, "Functie").alias("listed"), html.value_of(plain, "Waar").alias("tabled"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '.'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, unnest(['place', 'hours', 'rate']) AS field, unnest(l[1:3]) AS s FROM s), v AS (SELECT doc_id, field, regexp_replace(s, '[\s.,;:|–-]+$', '') AS value FROM c WHERE s IS NOT NULL)
SELECT doc_id, field, value FROM v WHERE value <> '' AND lower(value) NOT IN ('-', 'n.v.t', 'nvt', 'onbekend', 'geen', 'in overleg', 'nader te bepalen')""")
def texts_between_labels(t):
    """Every sentence of every text behind a label, by turns of three; the first of each label counts."""
    labels = {"place": "Locatie", "hours": "Uren per week", "rate": "Tarief"}
    sentences = F.filter(F.transform(F.split(html.strip(F.col("text")), r"\."), lambda s: F.trim(s)), lambda s: s != "")
    marks = F.array(*(F.lit(f"{label}: ") for label in labels.values()))
    line = F.array_join(F.transform(sentences, lambda s, i: F.concat(F.get(marks, (i % len(labels)).cast("int")), s)), ". ")
    return t.documents.select("doc_id", F.explode(html.between_labels(line, labels)).alias("field", "value"))


@query(rf"""
WITH b AS (SELECT page_id, page_id % 3 AS k, trim(regexp_replace(regexp_replace({_REMOVED}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body, {_LIST_SQL} AS title FROM pages)
SELECT page_id, md5(CASE WHEN k = 0 AND length(title) >= 24 AND len(string_split(title, ' ')) >= 4 THEN title WHEN k < 2 AND length(body) >= 24 AND len(string_split(body, ' ')) >= 4 THEN body END) AS digest FROM b""")
def pages_described(t):
    """Titles as linked data's descriptions where they will do, else the whole page as a main part, where there is one."""
    k = F.col("page_id") % 3
    linked = F.when(k == 0, F.concat(F.lit("<p>"), html.title(F.col("html")), F.lit("</p>"))).otherwise("kort")
    page = F.when(k < 2, F.concat(F.lit("<nav>x</nav><main id='m'>"), "html", F.lit("</main>"))).otherwise(F.col("html"))
    return t.pages.select("page_id", F.md5(html.description(linked, page)).alias("digest"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) - 3600001 WHEN 1 THEN epoch_ms(date_trunc('second', ts)) - 3600000 WHEN 2 THEN epoch_ms(date_trunc('second', ts)) WHEN 3 THEN epoch_ms(date_trunc('second', ts)) - 19800000 END AS closing_ms
FROM events WHERE month(ts) IN (1, 2, 11, 12)""")
def events_closing(t):
    """Moments of winter as deadlines: days end with the local day, times without offset are local, offsets are honoured."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    of = lambda form: F.date_format(ts, form)
    stamp = of("yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(k == 0, F.concat(F.lit(" "), of("yyyy-MM-dd"))).when(k == 1, stamp).when(k == 2, F.concat(stamp, F.lit("Z"))).when(k == 3, F.concat(stamp, F.lit("+05:30"))).otherwise(of("dd MMM"))
    return t.events.where(F.month("ts").isin(1, 2, 11, 12)).select("event_id", F.unix_millis(values.closing_moment(written)).alias("closing_ms"))


@query(r"""
WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE regexp_extract(text, '^\s*(\S+)', 1) END AS name, CASE WHEN length(text) % 2 = 0 THEN role || length(text) % 5 || '@x.nl' END AS email, CASE WHEN length(text) % 5 = 0 THEN role END AS kind FROM conversations),
k AS (SELECT * FROM p WHERE email IS NOT NULL OR (trim(name) <> '' AND trim(kind) <> '')), f AS (SELECT conv_id, name, email, min(turn) AS turn FROM k GROUP BY 1, 2, 3)
SELECT conv_id, coalesce((SELECT string_agg(coalesce(name, '-') || ':' || coalesce(email, '-'), ',' ORDER BY turn, name, email) FROM f WHERE f.conv_id = c.conv_id), '') AS kept FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def conversations_contacts(t):
    """The speakers of each conversation as contacts, in the order of their turns; some can't be reached, some come again in capitals."""
    n = F.length("text")
    name = F.when(n % 3 != 0, F.regexp_extract("text", r"^\s*(\S+)", 1))
    email = F.when(n % 2 == 0, F.concat("role", (n % 5).cast("string"), F.when(F.col("turn") % 2 == 0, "@X.NL").otherwise("@x.nl")))
    person = F.struct(name.alias("name"), email.alias("email"), F.lit(None).cast("string").alias("phone"), F.when(n % 5 == 0, F.col("role")).alias("role"))
    turns = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", person.alias("p")))), lambda x: x["p"]).alias("people"))
    told = F.array_join(F.transform(values.contacts(F.col("people")), lambda p: F.concat(F.coalesce(p["name"], F.lit("-")), F.lit(":"), F.coalesce(F.lower(p["email"]), F.lit("-")))), ",")
    return turns.select("conv_id", told.alias("kept"))


@query(rf"""
WITH w AS (SELECT page_id, {_LIST_SQL} AS title, length(html) AS n FROM pages)
SELECT page_id, title, '2024-01-0' || (n % 9 + 1) AS date_posted, CASE n % 3 WHEN 0 THEN 'uur' WHEN 1 THEN 'maand' END AS salary_unit, n::DOUBLE AS salary_min, CASE WHEN n % 2 = 0 THEN n + 0.5 ELSE n END::DOUBLE AS salary_max,
  CASE WHEN n % 4 = 0 THEN 'INTERN,TEMPORARY' ELSE 'FULL_TIME' END AS employment, CASE WHEN n % 5 = 0 THEN 'HBO' WHEN n % 5 = 1 THEN 'bachelor' END AS education FROM w""")
def pages_posting_facts(t):
    """Postings made of each page's title and length, in the shapes that sites write, read from the page."""
    n = F.length("html")
    null = F.lit(None).cast("string")
    value = F.when(n % 2 == 0, F.to_json(F.struct(n.alias("minValue"), (n + F.lit(0.5)).alias("maxValue"), F.when(n % 3 == 0, "HOUR").when(n % 3 == 1, "month").otherwise("WEEK").alias("unitText"))))
    value = value.when(F.lit(True), F.to_json(F.struct(n.alias("value"), F.when(n % 3 == 0, "hour").when(n % 3 == 1, "MONTH").otherwise(null).alias("unitText"))))
    kinds = F.when(n % 4 == 0, '["INTERN", "TEMPORARY"]').otherwise('"FULL_TIME"')
    school = F.when(n % 5 == 0, '{"credentialCategory": "HBO"}').when(n % 5 == 1, '"bachelor"').otherwise("null")
    title = F.to_json(F.struct(F.concat(F.lit("<b>"), html.title(F.col("html")), F.lit("</b>")).alias("title")))
    head = F.concat(F.regexp_replace(title, r"\}$", ""), F.lit(', "@type": "JobPosting", "datePosted": "2024-01-0'), (n % 9 + 1).cast("string"), F.lit('", "employmentType": '), kinds)
    node = F.concat(head, F.lit(', "educationRequirements": '), school, F.lit(', "baseSalary": {"value": '), value, F.lit("}}"))
    page = F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>"), "html")
    found = html.posting_facts(html.linked_data(t.pages.select("page_id", page.alias("html")), "page_id", "html"))
    return found.select("page_id", "title", "date_posted", "salary_unit", "salary_min", "salary_max", F.array_join("employment", ",").alias("employment"), "education")
