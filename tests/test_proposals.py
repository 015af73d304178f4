import pytest
from pyspark.sql import functions as F

from sluice.functions import html, proposals


def told(spark, rows, **columns):
    df = spark.createDataFrame(rows, "i int, d string, m string, p string, l string, s string")
    found = proposals.proposals(F.col("d"), F.col("m"), F.col("p"), F.col("l"), F.col("s"), **columns)
    return {r["i"]: {x["field"]: x for x in r["x"]} for r in df.select("i", found.alias("x")).collect()}


def said(spark, text, **more):
    return {k: x["value"] for k, x in told(spark, [(0, text, more.get("m"), more.get("p"), more.get("l"), more.get("s"))])[0].items()}


def test_every_field(spark):
    text = "Een mooie rol. Standplaats: Den Haag, Opdrachtgever: Gemeente X. Contractvorm: ZZP Werkvorm: hybride; Uren per week: 32 tot 36 uur. Gewenste opleiding: HBO Startdatum: 1/9/2026 Einddatum: 31 december 2026. Reageren tot: 2026-08-01T12:00:00+02:00 Tarief: € 80 - € 95 per uur"
    page = "<main>De hele pagina vertelt wat de rol inhoudt</main>"
    got = said(spark, text, p=" 2026-07-01 ", m=page)
    assert got == {
        "place": {"place": "Den Haag"}, "client": {"client": "Gemeente X"}, "contract": {"contract": "zzp"}, "work_form": {"work_form": "hybride"}, "hours": {"hours": "32–36"},
        "education": {"education": "HBO"}, "starts": {"starts": "2026-09-01"}, "ends": {"ends": "2026-12-31"}, "closes": {"closes": "2026-08-01T10:00:00.000Z"},
        "rate": {"rate_min": "80.0", "rate_max": "95.0", "rate_unit": "uur", "rate_currency": "EUR"}, "posted": {"posted": "2026-07-01"},
    }


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Opleiding: n.v.t. Klant: geen", {}), ("Klant: x", {}), ("Start: per direct", {}), ("Einddatum: 30-02-2026", {}), ("Deadline: 2026-02-30", {}),
        ("Locatie: Startdatum: 2026-01-05", {"place": {"place": "Startdatum: 2026-01-05"}, "starts": {"starts": "2026-01-05"}}),
        ("Sublocatie: Gent", {"place": {"place": "Gent"}}), ("Locatie:", {}), ("", {}), (None, {}), ("Uren per week: bespreekbaar", {}),
        ("Deadline: 2026-07-01T12:00:00", {"closes": {"closes": "2026-07-01T10:00:00.000Z"}}), ("Locatie: A Locatie: B", {"place": {"place": "A"}}),
    ],
)
def test_values_that_say_something(spark, text, want):
    assert said(spark, text) == want


def test_pages_lists_and_excerpts(spark):
    page = "<dl><dt>Locatie</dt>\n<dd>Delft</dd></dl><table><tr><th>Klant</th><td>Waterschap <b>Y</b></td></tr></table>"
    got = told(spark, [(0, "Tekst vooraf die lang genoeg is.", page, None, None, None)])[0]
    assert got["place"]["value"] == {"place": "Delft"} and got["client"]["value"] == {"client": "Waterschap Y"}
    assert got["place"]["excerpt"] == "die lang genoeg is. Locatie: Delft Klant: Waterschap Y" and got["place"]["confidence"] == 0.9
    long = told(spark, [(0, "x" * 500_000 + " Locatie: Delft " + "Klant: Y " + "z" * 500_000, None, None, None, None)])[0]
    assert long["place"]["value"] == {"place": "Delft"} and len(long["place"]["excerpt"]) == 20 + len("Locatie: Delft") + 40


def test_description_takes_the_place_of_a_stand_in_only(spark):
    body = "Bouwen aan een net dat iedereen gebruikt"
    page = f"<nav>Menu</nav><main><p>{body}</p></main>"
    rows = [(0, "T (x/1)", page, "gisteren", None, "T (x/1)"), (1, "eigen", page, None, None, "T (x/1)"), (2, "T (x/1)", page, None, f"<b>Linked: {body}</b>", "T (x/1)"), (3, "T (x/1)", "<main>We use cookies and more cookies here</main>", "2026-02-30", None, "T (x/1)")]
    got = {i: {k: (x["value"], x["path"]) for k, x in v.items()} for i, v in told(spark, rows, fields=("description", "posted")).items()}
    assert got == {0: {"description": ({"description": body}, "page.main")}, 1: {}, 2: {"description": ({"description": f"Linked: {body}"}, "linked.description")}, 3: {}}


def test_furniture_is_no_description(spark):
    rows = ["Home | Menu | Contact - Privacybeleid inloggen registreren", "Accepteer cookies", "Accept the use of all our cookies please now", "Home is waar je hart is, zegt men hier"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(html.usable(F.col("t"))).collect()] == [None, None, None, rows[3]]


def test_a_label_is_looked_for_once(spark):
    """Each pass of a label's pattern over a long text counts: one finds label and value, and most places fail on a letter."""
    text = "De organisatie start met een deadline en een locatie in de regio, aanvang en einde in overleg. " * 10
    df = spark.range(1).select(F.concat(F.lit(text), F.lit("Klant: Gemeente Y Deadline: 1-2-2026")).alias("t")).localCheckpoint()
    plan = df.select(proposals.proposals(F.col("t"), fields=("client", "closes")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Uiterste reactiedatum|Reactiedatum|Deadline|Closing date|Apply by|Sollicitatiedatum)") == 2  # in the text, and in what was found
    got = {x["field"]: (x["value"], x["excerpt"]) for x in df.select(proposals.proposals(F.col("t"), fields=("client", "closes")).alias("x")).first()["x"]}
    assert got == {"client": ({"client": "Gemeente Y"}, "n einde in overleg. Klant: Gemeente Y Deadline: 1-2-2026"), "closes": ({"closes": "2026-02-01"}, ". Klant: Gemeente Y Deadline: 1-2-2026")}


@pytest.mark.parametrize("field", proposals.LABELS)
def test_every_label_passes_the_look_at_its_letters(spark, field):
    import re

    forms = [re.sub(r"\(\?:[^)]*\)\?|.\?", "", x).replace(r"\/", "/") for x in re.split(r"\|(?![^(]*\))", proposals.LABELS[field])]
    values = {"hours": "36 uur", "starts": "1-2-2026", "ends": "1-2-2026", "closes": "1-2-2026"}
    df = spark.createDataFrame([(i, f"x {c}: {values.get(field, 'iets')}") for i, f in enumerate(forms) for c in (f, f.upper(), f.lower())], "i int, t string")
    assert all(r["x"] is not None for r in df.select(proposals.labelled(F.col("t"), field).alias("x")).collect())
