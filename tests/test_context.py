import datetime
import decimal
import hashlib
import json
import random

import pytest

from sluice.functions import cells
from sluice.operators import context

AUDIT = "id long, actor string, scope string, action string, class string, at string"
STORED = "id string, actor string, scope string, at string"


@pytest.fixture(scope="module")
def audit():
    rng = random.Random(4)
    actions = [*context.SHOWN, "login", None]
    return [(i, rng.choice(["a", "a", "b", None]), rng.choice(["s", "t"]), rng.choice(actions), "c", f"2024-01-{rng.randint(1, 9):02d}") for i in range(300)]


def shown(audit, actor, scope):
    own = sorted((r for r in audit if (r[1], r[2]) == (actor, scope)), key=lambda r: (r[5], r[0]), reverse=True)[: context.RECENT]
    return [{"action": r[3], "class": r[4], "at": r[5], "entity": context.SHOWN[r[3]]} for r in own if r[3] in context.SHOWN]


def test_contexts_of_many_requests(spark, audit):
    requests = [(1, "a", "s", None, None), (2, "a", "s", "q1", "p1"), (3, "b", "s", "q1", None), (4, "a", "t", "q1", None), (5, "b", "t", "none", "none"), (6, "new", "s", None, "p2"), (7, "a", "s", None, "p2"), (8, "a", "s", None, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    granted = frame([("a", "read"), ("a", "read"), ("a", "write"), ("b", "read")], "actor string, permission string")
    registry = frame([("z.read", "read", "o1", "read"), ("a.read", "read", "o2", "read"), ("w", "internal-write", "o3", "write")], "id string, effect string, outcome string, permission string")
    held = context.authorised(granted, registry, frame([("w",), ("w",)], "id string"))
    searches, snapshots = frame([("q1", "a", "s", "2024-02-01")], STORED), frame([("p1", "a", "s", "2024-02-02"), ("p2", "new", "s", "2024-02-03")], STORED)
    asked = frame(requests, "request long, actor string, scope string, search string, snapshot string")
    got = {r["request"]: r.asDict(True) for r in context.operator_context(asked, frame(audit, AUDIT), searches, snapshots, held).collect()}
    assert len(got) == len(requests)
    errors = {3: "search_not_found", 4: "search_not_found", 5: "search_not_found", 7: "snapshot_not_found"}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == errors
    assert all(got[k]["activity"] is None and got[k]["digest"] is None for k in errors)
    assert got[2]["activity"] == shown(audit, "a", "s") and 0 < len(got[2]["activity"]) < context.RECENT
    assert got[2]["observed"] == got[2]["activity"][0]["at"]
    assert [c["id"] + c["availability"] for c in got[2]["capabilities"]] == ["a.readavailable", "wunavailable", "z.readavailable"]
    assert (got[2]["search_state"], got[2]["snapshot_state"], got[1]["search_state"]) == ("present", "present", "not_applicable")
    assert got[6]["activity"] == got[6]["capabilities"] == [] and got[6]["observed"] is None
    assert got[1]["digest"] == got[8]["digest"] != got[2]["digest"]
    one = {"name": context.CONTRACT, "version": context.VERSION, "actor": "new", "scope": "s", "activity": [], "capabilities": [], "search": {"id": None, "state": "not_applicable", "at": None}, "snapshot": {"id": "p2", "state": "present", "at": "2024-02-03"}}
    assert got[6]["digest"] == hashlib.sha256(json.dumps(one, separators=(",", ":")).encode()).hexdigest()


def test_availability_is_unknown_unless_told_and_empty_tables_give_nothing(spark, audit):
    granted = spark.createDataFrame([("a", "read")], "actor string, permission string")
    registry = spark.createDataFrame([("x", "read", "o", "read")], "id string, effect string, outcome string, permission string")
    assert context.authorised(granted, registry).first()["capabilities"][0]["availability"] == "unknown"
    none = spark.createDataFrame([], AUDIT)
    assert context.recent_activity(none).count() == 0


def test_activity_is_ranked_before_it_is_shuffled(spark, audit):
    plan = context.recent_activity(spark.createDataFrame(audit, AUDIT).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]


def test_cells_lose_nothing(spark):
    schema = "n long, i int, d decimal(20,0), m decimal(10,2), f double, s string, b binary, t timestamp, z timestamp_ntz, y date, o boolean, a array<struct<x: long, k: map<string, array<string>>>>"
    utc = datetime.timezone.utc
    moment = datetime.datetime(2024, 3, 1, 4, 5, 6, 789123, tzinfo=utc)
    rows = [
        (2**53 - 1, 3, decimal.Decimal(12), decimal.Decimal("1.50"), 0.1, 'q"\\\n é', b"\x00\xff", moment, moment.replace(tzinfo=None), datetime.date(2024, 2, 29), True, [(2**53, {"b": ["1", None], "a": None}), None]),
        (-(2**63), -1, decimal.Decimal(10**19), None, float("nan"), "", b"", None, None, None, False, []),
        (None, None, None, None, float("-inf"), None, None, None, None, None, None, None),
    ]
    got = [json.loads(r["json"]) for r in cells.as_json(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == {
        "n": 2**53 - 1, "i": 3, "d": 12, "m": "1.50", "f": 0.1, "s": 'q"\\\n é', "b": [0, 255], "t": "2024-03-01T04:05:06.789Z", "z": "2024-03-01T04:05:06.789Z",
        "y": "2024-02-29T00:00:00.000Z", "o": True, "a": [{"x": str(2**53), "k": {"a": None, "b": ["1", None]}}, None],
    }
    assert got[1] == {"n": str(-(2**63)), "i": -1, "d": str(10**19), "m": None, "f": None, "s": "", "b": [], "t": None, "z": None, "y": None, "o": False, "a": []}
    assert set(got[2].values()) == {None} and len(got[2]) == 12


def test_cells_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.sql("SELECT timestamp_seconds(0) AS t")
        assert json.loads(cells.as_json(rows).first()["json"]) == {"t": "1970-01-01T00:00:00.000Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
