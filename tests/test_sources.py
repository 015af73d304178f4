import json

from pyspark.sql import functions as F

from sluice.sources import listings, stores


def page(total, data):
    return json.dumps({"capturedAt": "2026-01-01T00:00:00Z", "source": "striive", "contentType": "json", "payload": {"total": total, "data": data}})


def test_listing_to_drafts(spark, tmp_path):
    job = {"id": 7, "title": "Data <b>engineer</b>", "content": "<p>Tarief € 80,- tot € 95,- per uur, hybride. Freelance.</p>", "clientName": "Gemeente", "location": "Utrecht", "hoursPerWeekMin": 32, "hoursPerWeekMax": 40, "closingDateClient": "2026-07-01"}
    (tmp_path / "a.json").write_text(page(3, [job, {"id": None, "referenceCode": "R-1", "title": "", "content": None}]))
    (tmp_path / "b.json").write_text(page(3, [{"title": "x"}]))
    pages, site = listings.read(spark, str(tmp_path)), listings.SITES["striive"]
    assert tuple(listings.total(pages, site).first()) == (3, 3)
    got = {r["ref"]: r for r in listings.drafts(listings.records(pages, site), site).collect()}
    d = got["7"]
    assert (d["title"], d["province"], d["hours_min"], d["hours_max"], tuple(d["rate"]), d["contract"], d["work_form"], d["problems"]) == ("Data engineer", "Utrecht", 32, 40, (80, 95, "uur"), "freelance", "hybride", [])
    assert str(d["closing"]) == "2026-07-01 21:59:59.999000"
    assert got["R-1"]["problems"] == ["no title", "no description"] and got[None]["problems"] == ["no key", "no description"]


#: A stored record of each site, and what of its draft follows from it.
STORED = {
    "opdrachtoverheid": ({"tender_id": "t1", "tender_name": "Adviseur", "tender_buying_organization": "Gemeente", "vacancies_location": {"province": "Zuid-Holland"}, "tender_min_hours": 0, "tender_max_hours": 0, "tender_hours_week": "32", "tender_tariff": "maximaal 106,50", "tender_offline_date": "2026-09-01", "education_level_obj": {"education_level_label": "Onbekend"}},
                         {"ref": "t1", "description": "Adviseur", "place": "Zuid-Holland", "province": "Zuid-Holland", "hours_min": 32.0, "hours_max": 32.0, "rate": (None, 106.5, "uur"), "education": None}),
    "mercell": ({"TenderId": 12, "TenderName": "Wegen", "TenderDescription": "<p>Onderhoud van wegen</p>", "OrganizationName": "Provincie", "Deadline": "2026-09-01T10:00:00Z"}, {"ref": "12", "description": "Onderhoud van wegen", "client": "Provincie"}),
    "needstaffing": ({"detail": {"id": "15599", "titel": "PM", "locatie": "Den Haag", "uren": "32 - 36 uur", "start": "1788220800000", "deadline": "1788220800000", "tarief": "€ 80 - 95 per uur", "tariefMin": "80", "tariefMax": "95,5", "werkvorm": "Hybride", "periode": "4 maanden", "competenties": ["Scherp", " scherp ", "Rust"]}, "listing": {"opdrachtgeverNaam": "Rijk"}, "raw": {"html": "<p>Tekst</p>"}},
                     {"ref": "15599", "hours_min": 32.0, "hours_max": 36.0, "rate": (80.0, 95.5, "uur"), "work_form": "hybride", "duration": "4 maanden", "skills": ["Scherp", "Rust"], "starts": "2026-09-01T00:00:00.000Z"}),
    "flinter": ({"listing": {"slug": "vergunning", "titel": "V", "locatiePlaats": "Ede", "looptijdTekst": "1 jr"}, "detail": {"titel": "Vergunning", "beschrijvingHtml": "", "urenPerWeek": "36"}}, {"ref": "vergunning", "description": "Vergunning", "hours_max": 36.0, "duration": "1 jr", "starts": None, "closing": None}),
    "freelancer-nl": ({"listing": {"titel": "x", "budget": "€30 — €40 Per Uur"}, "detail": {"bronReferentie": "f1", "titel": "Site", "omschrijvingHtml": "<p>Bouw</p>", "geplaatst": "Geplaatst 12 uur geleden", "start": "01-10-2026", "skills": ["PHP"]}}, {"ref": "f1", "rate": (30.0, 40.0, "uur"), "starts": "2026-10-01", "posted": None, "skills": ["PHP"]}),
    "prounity": ({"detail": {"uuid": "u", "titel": "Dev", "land": "Belgium", "periode": "12/10/2026 - 31/12/2026", "duur": "2 months", "skills": [{"naam": "Java"}, {"naam": "Go"}]}, "listing": {"url": "x"}, "raw": {"html": "<p>Mission</p>"}}, {"starts": "2026-10-12", "ends": "2026-12-31", "skills": ["Java", "Go"], "place": "Belgium"}),
    "linkedin": ({"listing": {"bronReferentie": "jobs/view/a-1", "titel": "Dev", "opdrachtgever": "B", "locatie": "Utrecht", "geplaatst": "2026-09-01"}, "detail": {"description": "<b>Freelance</b> werk"}}, {"ref": "jobs/view/a-1", "client": "B", "contract": "freelance", "province": "Utrecht"}),
    "indeed": ({"jobkey": "k", "card": {"company": "C", "pubDate": 1788220800000, "extractedSalary": {"min": 0, "max": 45, "type": "HOURLY"}}, "detail": {"jobTitle": "Dev", "formattedLocation": "Delft, Zuid-Holland", "remoteWorkModel": {"text": "Hybride werken"}, "sanitizedJobDescription": "<p>Iets</p>"}}, {"ref": "k", "client": "C", "rate": (None, 45.0, "uur"), "province": "Zuid-Holland", "work_form": "hybride"}),
}


def test_every_site_has_drafts(spark):
    assert set(STORED) | {"striive", "inhuurdesk", "tenderned", "onefellow", "ctm", "harveynash", "werk-nl"} == set(listings.SITES)
    for name, (record, want) in STORED.items():
        site = listings.SITES[name]
        pages = spark.createDataFrame([(json.dumps({site.records[2:]: [record, {}]}),)], "payload string")
        draft, empty = listings.drafts(listings.records(pages, site), site).collect()
        got = {k: tuple(draft[k]) if k == "rate" else draft[k] for k in want}
        assert got == want, name
        assert empty["ref"] is None and empty["problems"][0] == "no key" and empty["skills"] == []
    freelancer = listings.SITES["freelancer-nl"]
    fixed = json.dumps({"items": [{"listing": {"budget": "€1000 — €2000 Vaste Prijs"}, "detail": {"titel": "Site"}}]})
    draft = listings.drafts(listings.records(spark.createDataFrame([(fixed,)], "payload string"), freelancer), freelancer).first()
    assert draft["rate"] is None or tuple(draft["rate"])[:2] == (None, None)


def test_excluded_keeps_the_first_of_each_url(spark):
    df = spark.createDataFrame([(0, "/a"), (1, "/login"), (2, "/b"), (3, "/a")], "pos int, url string")
    assert [r["pos"] for r in listings.excluded(df, "url", ["login"]).orderBy("pos").collect()] == [0, 2]


def test_raw_store(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2026-01-02 00:00:00", "json", bytearray(b"{}")), ("s", "2026-01-05 00:00:00", "json", bytearray(b"{}")), ("t", "2026-02-02 00:00:00", "html", bytearray(b"<p>"))], "slug string, at string, kind string, body binary")
    refs = {r["ref"] for r in stores.put_raw(rows, str(tmp_path / "raw")).collect()}
    assert len(refs) == 2 and all(r.startswith("raw/") for r in refs)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 and stores.broken(spark, str(tmp_path / "raw")).count() == 0


def test_corpus_is_the_same_every_time(spark):
    a, b = stores.corpus(spark, 500), stores.corpus(spark, 500).repartition(3)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert a.select(F.countDistinct("title")).first()[0] == 20


def test_import_window_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-03")], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    once = stores.import_window(rows, rows.limit(0), ["id"], "at", "2026-01-02")
    assert [r["id"] for r in once.collect()] == [1]
    assert stores.import_window(rows, once, ["id"], "at", "2026-01-02").count() == 0
