from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice.operators import telemetry

NOW = datetime(2026, 1, 1, 12)
MINUTE = 60_000


def ago(m):
    return None if m is None else NOW - timedelta(minutes=m)


SHAPE = (
    "source string, active boolean, status string, terms string, active_run string, outcome string, phase string, phase_started timestamp, progress_at timestamp, last_success timestamp, next_due timestamp,"
    "run_started timestamp, run_status string, runtime_status string, runtime_updated timestamp, heartbeat_at timestamp, heartbeat_ms long, lock_checked_at timestamp, lock_ms long, run_ms long, curation_ms long, available boolean"
)


def row(number, source=None, state=None, run=None, runtime=None, available=True):
    """One case as a row of ``telemetry.joined``; moments are minutes ago."""
    own = {"active": True, "status": "ready", "terms": "toegestaan"} | (source or {})
    has = state or {}
    work = {"status": "running", "updated": 1, "beat": 1, "beat_ms": 5 * MINUTE, "lock": 1, "lock_ms": 5 * MINUTE, "run_ms": 60 * MINUTE, "curation_ms": 30 * MINUTE}
    work = dict.fromkeys(work) if runtime == "none" else work | (runtime or {})
    begun, kind = (ago(run[1]), run[0]) if run else (None, None)
    return (
        str(number), own["active"], own["status"], own["terms"], has.get("run"), has.get("outcome"), has.get("phase"), *(ago(has.get(k)) for k in ("phase_started", "progress", "success", "due")),
        begun, kind, work["status"], ago(work["updated"]), ago(work["beat"]), work["beat_ms"], ago(work["lock"]), work["lock_ms"], work["run_ms"], work["curation_ms"], available,
    )


FINE = {"success": 30, "due": 0, "outcome": "complete"}


CASES = [
    ({"state": FINE}, "aggregate", ("green", "healthy", None)), ({"state": FINE}, "freshness", ("ok", "last_full_success_fresh", 30 * MINUTE)),
    ({"source": {"terms": "verboden", "active": False}}, "aggregate", ("blocked", "source_blocked", None)), ({"source": {"active": False}}, "aggregate", ("inactive", "source_inactive", None)),
    ({"source": {"status": "draft"}}, "process", ("blocked", "source_blocked", None)), ({}, "aggregate", ("unknown", "freshness_unknown", None)),
    ({"state": FINE | {"due": 29}}, "aggregate", ("red", "freshness_stale", 30 * MINUTE)), ({"state": FINE | {"due": None}}, "aggregate", ("unknown", "freshness_policy_unknown", 30 * MINUTE)),
    ({"state": FINE | {"outcome": "quarantined"}}, "freshness", ("stale", "current_run_parked", 30 * MINUTE)), ({"state": FINE | {"outcome": "odd"}}, "freshness", ("unknown", "current_run_unknown", 30 * MINUTE)),
    ({"state": FINE, "runtime": {"beat": 6}}, "aggregate", ("red", "worker_dead", 6 * MINUTE)), ({"state": FINE, "runtime": {"beat_ms": None}}, "aggregate", ("unknown", "process_policy_unknown", MINUTE)),
    ({"state": FINE, "runtime": {"beat": None}}, "aggregate", ("unknown", "process_telemetry_unknown", None)), ({"state": FINE, "runtime": {"status": "lock_lost"}}, "aggregate", ("red", "advisory_lock_not_owned", MINUTE)),
    ({"state": FINE, "runtime": {"status": "stopped", "updated": 3}}, "lock", ("failed", "lock_lost", 3 * MINUTE)), ({"state": FINE, "runtime": {"lock": 6}}, "lock", ("stale", "lock_observation_stale", 6 * MINUTE)),
    ({"state": FINE, "runtime": {"lock_ms": None}}, "aggregate", ("unknown", "lock_policy_unknown", MINUTE)), ({"state": FINE, "runtime": {"status": "starting"}}, "aggregate", ("unknown", "advisory_lock_unknown", MINUTE)),
    ({"state": FINE | {"run": "r", "progress": 10}, "run": ("running", 90)}, "aggregate", ("progressing", "progressing", 10 * MINUTE)),
    ({"state": FINE | {"run": "r", "progress": 40, "phase": "curation"}, "run": ("succeeded", 90)}, "aggregate", ("red", "progress_stalled", 40 * MINUTE)),
    ({"state": FINE | {"run": "r"}, "run": ("running", 90)}, "aggregate", ("red", "first_progress_overdue", 90 * MINUTE)),
    ({"state": FINE | {"run": "r", "phase_started": 5}, "run": ("running", 90)}, "aggregate", ("unknown", "progress_unknown", None)),
    ({"state": FINE | {"run": "r", "progress": 1}, "run": ("running", 90), "runtime": {"run_ms": None}}, "aggregate", ("unknown", "progress_policy_unknown", MINUTE)),
    ({"state": FINE | {"run": "r", "progress": 1}, "run": ("failed", 90)}, "freshness", ("stale", "current_run_incomplete", 30 * MINUTE)),
    ({"state": FINE | {"run": "gone", "progress": 1}}, "progress", ("ok", "no_active_run", None)),
    ({"state": FINE, "available": False}, "aggregate", ("unknown", "database_unknown", None)), ({"state": FINE, "available": False}, "process", ("unknown", "database_unavailable", None)),
    ({"state": FINE, "runtime": "none"}, "process", ("unknown", "never_reported", None)),
]


def test_signals(spark):
    rows = spark.createDataFrame([row(i, **given) for i, (given, _, _) in enumerate(CASES)], SHAPE)
    made = telemetry.signals(F.lit(NOW), F.col("available"))
    told = rows.select("source", *(made[k].alias(k) for k in telemetry.SIGNALS)).withColumn("aggregate", made["aggregate"])
    got = {int(r["source"]): r for r in told.collect()}
    for i, (given, signal, want) in enumerate(CASES):
        assert (got[i][signal]["state"], got[i][signal]["reason"], got[i][signal]["age_ms"]) == want, given


def test_snapshot_joins_what_is_there(spark):
    sources = spark.createDataFrame([("a", True, "ready", "toegestaan"), ("b", True, "ready", "toegestaan")], "source string, active boolean, status string, terms string")
    state = spark.createDataFrame([("a", "r", "complete", None, None, ago(1), ago(30), NOW)], "source string, active_run string, outcome string, phase string, phase_started timestamp, progress_at timestamp, last_success timestamp, next_due timestamp")
    runs = spark.createDataFrame([("r", ago(9), "running"), ("q", ago(9), "failed")], "run string, run_started timestamp, run_status string")
    shape = "component string, runtime_status string, runtime_updated timestamp, heartbeat_at timestamp, heartbeat_ms long, lock_checked_at timestamp, lock_ms long, run_ms long, curation_ms long"
    work = (5 * MINUTE, ago(1), 5 * MINUTE, 60 * MINUTE, 30 * MINUTE)
    runtime = spark.createDataFrame([("poller", "stopped", ago(900), ago(900), *work), ("poller", "running", ago(1), ago(1), *work), ("other", "stopped", NOW, None, *work)], shape)
    told = lambda rt: {r["source"]: r["aggregate"]["reason"] for r in telemetry.snapshot(sources, state, runs, rt, "poller", F.lit(NOW)).collect()}
    assert told(runtime) == {"a": "progressing", "b": "freshness_unknown"}
    assert told(runtime.limit(0)) == {"a": "process_telemetry_unknown", "b": "process_telemetry_unknown"}
    assert telemetry.snapshot(sources.limit(0), state, runs, runtime, "poller", F.lit(NOW)).count() == 0
