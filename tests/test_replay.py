import json

from sluice.operators import coverage
from sluice.sources import listings, replay


def capture(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"capturedAt": "2026-01-01T00:00:00Z", "payload": {"total": len(data), "data": data}}))
    return str(folder)


def job(i, title):
    return {"id": i, "title": title, "content": "Tekst"}


def test_replaying_the_same_capture_writes_nothing(spark, tmp_path):
    site, store = listings.SITES["striive"], str(tmp_path / "store")
    first = capture(tmp_path / "one", "a.json", [job(1, "A"), job(2, "B"), {"title": "no key"}])
    second = capture(tmp_path / "two", "a.json", [job(1, "A"), job(2, "B2"), job(3, "C"), job(3, "C3")])
    told = lambda *a, **k: tuple(replay.replay(spark, *a, **k).first())
    assert told(first, site, store) == ("striive", 3, 2, 0, 0, 1, 0)
    assert not (tmp_path / "store").exists()  # a dry run
    assert told(first, site, store, dry_run=False) == ("striive", 3, 2, 0, 0, 1, 0)
    assert told(first, site, store, dry_run=False) == ("striive", 3, 0, 0, 2, 1, 0)
    assert told(second, site, store, dry_run=False) == ("striive", 4, 1, 1, 1, 0, 1)
    assert told(second, site, store, dry_run=False) == ("striive", 4, 0, 0, 3, 0, 1)
    held = {(r["ref"], r["version"], r["title"]) for r in spark.read.parquet(store).collect()}
    assert held == {("1", 1, "A"), ("2", 1, "B"), ("2", 2, "B2"), ("3", 1, "C3")}


def test_an_empty_capture(spark, tmp_path):
    assert replay.replay(spark, capture(tmp_path / "none", "a.json", []), listings.SITES["striive"], str(tmp_path / "store"), dry_run=False).count() == 0


def audited(spark, rows):
    shape = "source string, client string, place string, starts string, closes timestamp, rate struct<min:double,max:double,unit:string>, extra string, rejected boolean"
    df = spark.createDataFrame(rows, shape)
    return {(r["source"], r["field"]): (r["records"], r["rejected"], r["landed"], r["share"]) for r in coverage.audit(df, "source", "extra").collect()}, {tuple(r) for r in coverage.keys(df, "source", "extra").collect()}


def test_coverage_counts_what_a_reader_sees(spark):
    extra = json.dumps({"contracttype": " ", "employment_type": "TEMPORARY, FULL_TIME", "duur": 0, "periode": "4 maanden", "publicatiedatum": "2026-02-30", "provincie": "Zuid-Holland", "skills": ["", "x" * 81], "uren_per_week": 36, "werkvorm": "unknown", "_cleared": ["a"], "leeg": [], "lijst": ["a"]})
    more = json.dumps({"contract_type": "iets", "employment_type": "TEMPORARY", "publicatiedatum": "2026-02-03", "skills": ["Java"], "opdrachtgeverNaam": "B", "provincie": "Brussel"})
    fields, keys = audited(spark, [("a", "unknown", "Delft", None, None, None, extra, False), ("a", " ", None, "2026-01-01", None, (None, None, "uur"), more, None), ("a", "C", None, None, None, None, None, True), ("b", "C", None, None, None, None, "no json", True)])
    assert {f: v[2] for (s, f), v in fields.items() if s == "a"} == {
        "client": 1, "place": 1, "rate": 1, "contract": 1, "work_form": 0, "posted": 1, "closes": 0, "hours": 1, "education": 0, "starts": 1, "ends": 0, "duration": 1, "province": 1, "skills": 1,
    }
    assert fields["a", "client"] == (2, 1, 1, 0.5) and fields["b", "client"] == (0, 1, 0, None)
    assert {k for s, k, n in keys if n == 2} == {"employment_type", "publicatiedatum", "provincie", "skills"}
    assert {k for s, k, n in keys} & {"_cleared", "leeg", "contracttype", "werkvorm"} == set() and ("a", "lijst", 1) in keys
