import datetime
import json

import pytest

from sluice.functions import html
from sluice.sources import linked_sites
from sluice.sources.linked_sites import SITES


def page(node, extra=""):
    return f'<html><script type="application/ld+json">{json.dumps(node)}</script>{extra}</html>'


def test_nodes_at_any_depth(spark):
    posting = {"@type": ["Thing", "JobPosting"], "title": "Dev", "x": {"@type": "JobPosting"}}
    deep = posting
    for k in range(7):
        deep = [{"@type": "Org"}, deep] if k % 2 else {"@graph": [deep, 5, None]}
    cases = [(0, page(posting)), (1, page(deep)), (2, page([[[]], {"@graph": {"@type": "JobPosting"}}])), (3, page({"about": posting})), (4, "<p>none</p>"), (5, None)]
    got = dict(html.linked_data(spark.createDataFrame(cases, "id int, html string"), "id", "html").select("id", "node").collect())
    assert {k: json.loads(v) for k, v in got.items()} == {0: posting, 1: posting}


def test_bluetrail_page(spark):
    node = {
        "@graph": [
            {"@type": "JobPosting", "title": "Adviseur <b>data</b>", "datePosted": "2026-01-05", "validThrough": "2026-02-01", "employmentType": ["CONTRACTOR"], "identifier": {"value": "n-1"}, "hiringOrganization": {"name": "Broker"},
             "description": "<p>Voor de Gemeente Delft zoeken wij een adviseur die data kan lezen.</p>", "jobLocation": {"address": {"addressLocality": "Utrecht"}}}
        ]
    }
    extra = "<b>Locatie</b>Delft</span><b>Uren per week</b>32 - 36</span><b>Startdatum</b>1 maart 2026<b>Referentienummer</b>BT-9<b>Einddatum</b>30 juni 2026<strong>Competenties:</strong><br><br><ul><li>SQL</li><li> sql </li><li>Spark</li></ul>"
    rows = [("https://www.bluetrail.nl/opdrachten/Interim/a/", page(node, extra)), ("https://www.bluetrail.nl/opdrachten/Interim/b/", "<p>weg</p>")]
    r = linked_sites.drafts(spark.createDataFrame(rows, "url string, html string"), SITES["bluetrail"]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["ref"], r["title"], r["client"], r["place"], r["starts"], r["ends"]) == ("BT-9", "Adviseur data", "Gemeente Delft", "Delft", "2026-03-01", "2026-06-30")
    assert (r["hours"]["min"], r["hours"]["max"], r["contract"], r["skills"], r["problems"]) == (32, 36, "freelance", ["SQL", "Spark"], [])
    assert r["posted"] == datetime.datetime(2026, 1, 5) and r["closing"] == datetime.datetime(2026, 2, 1, 22, 59, 59, 999000)


def test_circle8_and_plain_pages(spark):
    node = {"@type": "JobPosting", "title": "Recruiter", "description": "Je werkt tussen de 32 en 40 uur. Een maandsalaris van € 3.000 tot € 4.200 hoort erbij.", "jobLocation": [{"address": {"addressLocality": "Breda"}}]}
    df = spark.createDataFrame([("u", page(node, "<dt>Locaties</dt><dd> Tilburg </dd>"))], "url string, html string")
    r = linked_sites.drafts(df, SITES["circle8"]).first()
    assert (r["ref"], r["place"], r["hours"]["min"], r["hours"]["max"], r["rate"]["min"], r["rate"]["max"], r["rate"]["unit"]) == ("u", "Tilburg", 32, 40, 3000, 4200, "maand")
    r = linked_sites.drafts(df, SITES["hero"]).first()
    assert r["place"] == "Breda" and r["contract"] is None


@pytest.mark.parametrize(
    ("site", "body", "want"),
    [
        ("bluetrail", "<url><loc>https://www.bluetrail.nl/opdrachten/</loc></url><url><loc>https://www.bluetrail.nl/opdrachten/Interim/or-adviseur/</loc><lastmod>2026-01-01</lastmod></url><url><loc>https://www.bluetrail.nl/opdrachten/x/?order=date</loc></url>", ["https://www.bluetrail.nl/opdrachten/Interim/or-adviseur/"]),
        ("eneco", "<url><loc>https://www.werkenbijeneco.nl/vacatures/trader-2864</loc></url><url><loc>https://www.werkenbijeneco.nl/over-ons</loc></url>", ["https://www.werkenbijeneco.nl/vacatures/trader-2864"]),
        ("circle8", '<a href="/jobs/12-dev?x=1">a</a><a href="./jobs/12-dev?x=1">b</a><a href="/jobs">c</a><a href="../jobs/13-ops">d</a>', ["https://werkenbij.circle8.nl/jobs/12-dev?x=1", "https://werkenbij.circle8.nl/jobs/13-ops"]),
        ("hero", '<a href="/interim-opdrachten/devops-1f">a</a><a href="/api/interim-opdrachten/x">b</a>', ["https://hero.eu/interim-opdrachten/devops-1f"]),
        ("ns", '<a href="/vacatures/monteur-utrecht-1">a</a><a href="/vacatures">b</a><a href="https://elders.nl/vacatures/x-y">c</a>', ["https://elders.nl/vacatures/x-y", "https://www.werkenbijns.nl/vacatures/monteur-utrecht-1"]),
    ],
)
def test_postings_are_found(spark, site, body, want):
    df = spark.createDataFrame([(body,)], "body string")
    assert sorted(r["url"] for r in linked_sites.detail_urls(df, SITES[site]).collect()) == want
