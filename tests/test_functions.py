import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import contracts, html, values


def each(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hours(spark):
    got = each(spark, values.hours_text, ["32u p/w", "36 uur per week", "32-40 uur bespreekbaar", "tussen de 32 en 40 uur", "40", "32-36", "40-32 uur", "9am-5pm", "Full time", None, "36-36 uur"])
    assert got == ["32", "36", "32–40", "32–40", "40", "32–36", None, None, None, None, "36"]
    got = each(spark, values.hours_range, ["36", "32–40", "≥32", "≤40", "=32", "40-32", "ca 30", "", None, "36,5"])
    assert [(r["min"], r["max"]) for r in got] == [(36, 36), (32, 40), (32, None), (None, 40), (32, None), (None, None), (None, None), (None, None), (None, None), (36.5, 36.5)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tarief marktconform", (None, None, None)),
        ("€ 4.120,- en € 6.480,- per maand", (4120, 6480, "maand")),
        ("24 tot 36 uur in de week, salaris tussen € 3.310,- en € 4.905,-", (3310, 4905, "maand")),
        ("max tarief € 88 per uur", (None, 88, "uur")),
        ("tot 36 uur per week", (None, None, None)),
        ("uurtarief 71-84", (71, 84, "uur")),
        ("tarief per 03-11-2025", (None, None, None)),
        ("€ 1,234", (None, None, "uur")),
        ("€ 1.234,56 per dag", (None, 1234.56, "dag")),
        ("€ 12,5", (None, 12.5, "uur")),
        ("een bonus van € 500 en 20 vakantiedagen", (None, 500, "uur")),
        ("€ 90 - € 80", (None, 90, "uur")),
        ("€ 58.000 per jaar", (None, 58000, None)),
        ("tarief 80 - 95 jaarlijks herzien", (80, 95, None)),
        ("tarief 3 - 5 jaar", (None, None, None)),
    ],
)
def test_rates(spark, text, want):
    got = each(spark, values.rate, [text])[0]
    assert (got["min"], got["max"]) == want[:2]
    if want != (None, None, None):
        assert got["unit"] == want[2]


def test_contracts_and_places(spark):
    assert each(spark, values.contract_form, [" Contractor", "FULL_TIME", None, "zzp"]) == ["freelance", None, None, "freelance"]
    assert each(spark, values.agreed_contract, [["TEMPORARY", "FULL_TIME"], ["TEMPORARY", "CONTRACTOR"], [], None], "array<string>") == ["interim", None, None, None]
    assert each(spark, contracts.contract_in_text, ["Freelance of zzp", "geen zzp, interim", "vaste baan", "detachering of vaste baan", "niets"]) == ["freelance", "interim", "vast", "detachering", None]
    assert each(spark, values.work_form, ["hybride, deels remote", "100% remote", "op locatie", "x"]) == ["hybride", "remote", "op locatie", None]
    assert each(spark, values.province, ["Provincie: N-Holland", "NB", "Fryslân", "Nergens", None]) == ["Noord-Holland", "Noord-Brabant", "Friesland", None, None]
    assert each(spark, values.last_province, ["eerst Utrecht, dan Zuid-Holland.", "NB let op", "Gelderlander"]) == ["Zuid-Holland", None, None]


def test_dates(spark):
    assert each(spark, values.dutch_date, ["op 21 september 2026", "30 februari 2026", "1 foo 2026", None]) == [datetime.date(2026, 9, 21), None, None, None]
    got = each(spark, lambda c: values.closing_moment(c).cast("string"), ["2026-07-01", "2026-01-01", "2026-07-01T12:00:00", "2026-07-01T12:00:00Z", "2026-07-01T12:00:00+02:00", "x", None])
    assert got == ["2026-07-01 21:59:59.999", "2026-01-01 22:59:59.999", "2026-07-01 10:00:00", "2026-07-01 12:00:00", "2026-07-01 10:00:00", None, None]


def test_lists(spark):
    assert each(spark, values.skills, [[" Java", "java", "", "x" * 81, "Go", None], None], "array<string>") == [["Java", "Go"], None]
    people = [("A", "", None, "role"), ("A", "", None, "role"), ("B", "b@x", None, None), ("B", "B@X", None, None), ("C", None, None, None)]
    got = each(spark, values.contacts, [people], "array<struct<name:string,email:string,phone:string,role:string>>")[0]
    assert [(p["name"], p["email"]) for p in got] == [("A", ""), ("B", "b@x")]


def test_pages(spark):
    page = """<html><title> A <b>t</b> </title><script type="application/ld+json">{broken</script>
    <script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "JobPosting", "title": "Dev <i>x</i>", "employmentType": ["TEMPORARY", "FULL_TIME"],
    "baseSalary": {"value": {"minValue": 10, "maxValue": 20, "unitText": "HOUR"}}}]}</script>
    <dl><dt>Uren per week</dt><dd>32 uur.</dd></dl><a href="/jobs/1?x">1</a><a href='/jobs/1?x'>again</a><a href="https://o.org/jobs/2">2</a><a href="jobs/3">3</a><a href="/about">no</a></html>"""
    df = spark.createDataFrame([(1, "https://site.nl/list/all", page), (2, "https://b.nl", "<p>none")], "id int, url string, html string")
    nodes = html.posting_facts(html.linked_data(df, "id", "html")).collect()
    assert [(r["id"], r["title"], r["employment"], r["salary_min"], r["salary_max"], r["salary_unit"]) for r in nodes] == [(1, "Dev x", ["TEMPORARY", "FULL_TIME"], 10.0, 20.0, "uur")]
    got = html.links(df, "id", "url", "html", "/jobs/").orderBy("pos").collect()
    assert [r["href"] for r in got] == ["https://site.nl/jobs/1?x", "https://o.org/jobs/2", "https://site.nl/list/jobs/3"]
    assert df.select(html.title(F.col("html")).alias("t")).first()["t"] == "A t"
    lines = html.labelled(F.col("html"))
    assert df.select(html.value_of(html.strip(F.regexp_extract(lines, r"<dl>(.*?)\n", 1)), "Uren per week").alias("v")).first()["v"] == "32 uur"
    decoded = df.select(html.decode(F.lit("a &amp; b &#233; &nope; &#x41;"), df).alias("d")).first()["d"]
    assert decoded == "a & b é &nope; A"
    assert each(spark, html.usable, ["<nav>x</nav><p>Een baan met genoeg woorden erin</p>", "<p>te kort</p>", "We use cookies on this big site okay"]) == ["Een baan met genoeg woorden erin", None, None]


def test_id_hash_known_values(spark):
    assert each(spark, values.id_hash, ["a", "b", "😀a"]) == [7929297801672961, 8684336938537663, 880667864799818]
