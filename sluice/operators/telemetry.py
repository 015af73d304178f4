"""What a source's telemetry says: five signals with reason and age, and the state they add up to.

Telemetry lives in several tables: sources, their state, the runs they name and one row of the worker's runtime.  :func:`snapshot`
joins them; every signal is then a list of rules of which the first that holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.health import GRACE

#: Words of the stored tables (fixed values).
READY, BLOCKED, ALLOWED, FORBIDDEN = "ready", "blocked", "toegestaan", "verboden"
PHASES, LOST, PARKED = ("fetch", "persist", "curation"), ("lock_lost", "stopped"), ("quarantined", "parked")
SIGNALS = ("database", "process", "lock", "progress", "freshness")
Rules = list[tuple[Column, Column | str, str]]


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _first(rules: Rules, age: Column) -> Column:
    """``struct<state, reason, age_ms>`` of the first rule that holds."""
    state = reason = F
    for test, s, r in rules:
        state, reason = (of.when(_holds(test), F.lit(x) if isinstance(x, str) else x) for of, x in ((state, s), (reason, r)))
    return F.struct(state.alias("state"), reason.alias("reason"), age.alias("age_ms"))


def joined(sources: DataFrame, state: DataFrame, runs: DataFrame, runtime: DataFrame, component: str) -> DataFrame:
    """Every source beside its state, the run that its state names and the runtime of ``component``; what isn't there is null.

    ``sources``: ``source, active, status, terms``; ``state``, one row a source: ``source, active_run, outcome, phase, phase_started,
    progress_at, last_success, next_due`` (the first scheduled moment after the last success); ``runs``: ``run, run_started,
    run_status``; ``runtime``: ``component, runtime_status, runtime_updated, heartbeat_at, heartbeat_ms, lock_checked_at, lock_ms,
    run_ms, curation_ms``.  The latest runtime row of the component is one row, made by an aggregate, and is broadcast.
    """
    of = [c for c in runtime.columns if c != "component"]
    one = runtime.where(F.col("component") == component).agg(F.max_by(F.struct(*of), "runtime_updated").alias("_runtime"))
    told = sources.join(state, "source", "left").join(runs.select(F.col("run").alias("active_run"), "run_started", "run_status"), "active_run", "left")
    with_one = told.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one", "left")
    return with_one.select(*(c for c in told.columns), "_runtime.*")


def signals(now: Column, available: Column | None = None) -> dict[str, Column]:
    """The five signals and ``aggregate`` of a row of :func:`joined`.

    A source is blocked if its status or terms say so, inactive if it isn't active, and blocked unless it is ready and
    allowed.  Ages are in thousandths of a second and never below 0.  ``available`` tells whether the telemetry could be read.
    """
    there = F.lit(True) if available is None else available
    c = F.col
    age = lambda at: F.when(at.isNotNull(), F.greatest(F.unix_millis(now) - F.unix_millis(at), F.lit(0)))
    barred = _holds((c("status") == BLOCKED) | (c("terms") == FORBIDDEN))
    idle = ~barred & ~_holds(c("active"))
    usable = ~barred & ~idle & _holds((c("status") == READY) & (c("terms") == ALLOWED))
    closed: Rules = [(idle, "inactive", "source_inactive"), (~usable, "blocked", "source_blocked")]
    unread: Rules = [(~there, "unknown", "database_unavailable")]
    always = F.lit(True)

    database = _first([(~there, "unknown", "database_unavailable"), (always, "ok", "database_available")], F.when(there, F.lit(0).cast("long")))
    beat = age(c("heartbeat_at"))
    process = _first(
        closed + unread + [
            (c("heartbeat_at").isNull(), "unknown", "never_reported"), (c("heartbeat_ms").isNull(), "unknown", "process_policy_unknown"),
            (beat > c("heartbeat_ms"), "stale", "heartbeat_stale"), (always, "ok", "heartbeat_fresh"),
        ],
        F.when(usable & there, beat),
    )

    seen = F.when(c("runtime_status") == "stopped", c("runtime_updated")).otherwise(c("lock_checked_at"))
    held = c("runtime_status") == "running"
    lock = _first(
        closed + unread + [
            (c("runtime_status").isin(*LOST), "failed", "lock_lost"), (~_holds(held) | seen.isNull(), "unknown", "lock_not_reported"),
            (c("lock_ms").isNull(), "unknown", "lock_policy_unknown"), (age(seen) > c("lock_ms"), "stale", "lock_observation_stale"), (always, "ok", "lock_held"),
        ],
        F.when(usable & there, age(seen)),
    )

    phase = F.when(c("phase").isin(*PHASES), c("phase"))
    running = _holds(c("active_run").isNotNull() & ((c("run_status") == "running") | ((c("run_status") == "succeeded") & (phase == "curation"))))
    budget = F.when(phase == "curation", c("curation_ms")).otherwise(c("run_ms"))
    reported, waiting, moved = c("progress_at").isNotNull(), age(F.coalesce("phase_started", "run_started")), age(c("progress_at"))
    progress = _first(
        closed + [
            (~running, "ok", "no_active_run"), (budget.isNull(), "unknown", "progress_policy_unknown"),
            (~reported & (waiting > budget), "stale", "first_progress_overdue"), (~reported, "unknown", "progress_not_reported"),
            (moved > budget, "stale", "progress_stalled"), (always, "progressing", "progressing"),
        ],
        F.when(usable & running, moved),
    ).withField("waiting_ms", F.when(usable & running & ~reported, waiting))

    late = F.unix_millis(c("next_due")) - F.unix_millis(c("last_success")) + GRACE * 1000
    success, outcome = age(c("last_success")), c("outcome")
    freshness = _first(
        closed + [
            (c("run_status").isin("failed", "cancelled"), "stale", "current_run_incomplete"), (outcome.isin(*PARKED), "stale", "current_run_parked"),
            (outcome.isin("failed", "incomplete"), "stale", "current_run_incomplete"), (outcome == "backlogged", "stale", "current_run_backlogged"),
            (outcome != "complete", "unknown", "current_run_unknown"), (c("last_success").isNull(), "unknown", "never_succeeded"),
            (late.isNull(), "unknown", "freshness_policy_unknown"), (success > late, "stale", "last_full_success_stale"), (always, "ok", "last_full_success_fresh"),
        ],
        F.when(usable, success),
    )

    made = {"database": database, "process": process, "lock": lock, "progress": progress, "freshness": freshness}
    return made | {"aggregate": _aggregate({k: c(k) for k in SIGNALS})}


def _aggregate(s: dict[str, Column]) -> Column:
    """The first signal that decides, worst matters first: liveness before the lock, the lock before progress, progress before freshness."""
    state = lambda k, *of: s[k]["state"].isin(*of)
    why = lambda k: s[k]["reason"]
    none = F.lit(None).cast("long")
    decided = [  # test, state, reason, age
        (state("freshness", "inactive"), "inactive", F.lit("source_inactive"), none),
        (state("freshness", "blocked"), "blocked", F.lit("source_blocked"), none),
        (state("database", "unknown"), "unknown", F.lit("database_unknown"), s["database"]["age_ms"]),
        (state("process", "stale"), "red", F.lit("worker_dead"), s["process"]["age_ms"]),
        (state("process", "unknown"), "unknown", F.when(why("process") == "process_policy_unknown", why("process")).otherwise("process_telemetry_unknown"), s["process"]["age_ms"]),
        (state("lock", "failed", "stale"), "red", F.lit("advisory_lock_not_owned"), s["lock"]["age_ms"]),
        (state("lock", "unknown"), "unknown", F.when(why("lock") == "lock_policy_unknown", why("lock")).otherwise("advisory_lock_unknown"), s["lock"]["age_ms"]),
        (state("progress", "stale"), "red", why("progress"), F.coalesce(s["progress"]["age_ms"], s["progress"]["waiting_ms"])),
        (state("progress", "unknown"), "unknown", F.when(why("progress") == "progress_policy_unknown", why("progress")).otherwise("progress_unknown"), s["progress"]["age_ms"]),
        (state("progress", "progressing"), "progressing", F.lit("progressing"), s["progress"]["age_ms"]),
        (state("freshness", "stale"), "red", F.lit("freshness_stale"), s["freshness"]["age_ms"]),
        (state("freshness", "unknown"), "unknown", F.when(why("freshness") == "freshness_policy_unknown", why("freshness")).otherwise("freshness_unknown"), s["freshness"]["age_ms"]),
        (F.lit(True), "green", F.lit("healthy"), none),
    ]
    out = F
    for test, verdict, reason, age in decided:
        out = out.when(test, F.struct(F.lit(verdict).alias("state"), reason.alias("reason"), age.alias("age_ms")))
    return out


def snapshot(sources: DataFrame, state: DataFrame, runs: DataFrame, runtime: DataFrame, component: str, now: Column, available: Column | None = None) -> DataFrame:
    """``source`` and the five signals and ``aggregate``, a row for every source, those without any telemetry included."""
    rows = joined(sources, state, runs, runtime, component)
    made = signals(now, available)
    base = rows.select("source", *(made[k].alias(k) for k in SIGNALS))
    return base.withColumn("aggregate", made["aggregate"])
