"""Independent health signals of a source, and the one conclusion drawn from them, as tables of rules.

A rule is ``(condition, state, reason, age)``; the first that holds gives the signal, ``struct<state, reason, age>``.  Four of
the five signals watch a moment that should not be older than a limit and differ in their names alone (``WATCHES``) and
in what is asked before.  Ages are seconds before now, never negative; a limit that is null is an unknown policy, not a
passed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons of a watched moment: never seen, without a limit, too old, in time; and its state in time (fixed values).
WATCHES = {
    "process": ("never_reported", "process_policy_unknown", "heartbeat_stale", "heartbeat_fresh", "ok"),
    "lock": ("lock_not_reported", "lock_policy_unknown", "lock_observation_stale", "lock_held", "ok"),
    "progress": ("progress_not_reported", "progress_policy_unknown", "progress_stalled", "progressing", "progressing"),
    "freshness": ("never_succeeded", "freshness_policy_unknown", "last_full_success_stale", "last_full_success_fresh", "ok"),
}
#: What each state of a signal, in this order of signals, lets conclude; a reason of None is the signal's own (fixed values).
CONCLUSIONS = (
    ("database", "unknown", "unknown", "database_unknown"),
    ("process", "stale", "red", "worker_dead"),
    ("process", "unknown", "unknown", "process_telemetry_unknown"),
    ("lock", "failed", "red", "advisory_lock_not_owned"),
    ("lock", "stale", "red", "advisory_lock_not_owned"),
    ("lock", "unknown", "unknown", "advisory_lock_unknown"),
    ("progress", "stale", "red", None),
    ("progress", "unknown", "unknown", "progress_unknown"),
    ("progress", "progressing", "progressing", None),
    ("freshness", "stale", "red", "freshness_stale"),
    ("freshness", "unknown", "unknown", "freshness_unknown"),
)

Rule = tuple[Column, "Column | str", "Column | str", "Column | None"]


def first_rule(rules: list[Rule]) -> Column:
    """The signal of the first rule that holds."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = lambda state, reason, age: F.struct(text(state).alias("state"), text(reason).alias("reason"), (F.lit(None) if age is None else age).cast("long").alias("age"))
    out = F.lit(None)
    for condition, *signal in reversed(rules):
        out = F.when(condition, made(*signal)).otherwise(out)
    return out


def age(at: Column, now: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(at), F.lit(0))


def watched(name: str, at: Column, limit: Column, now: Column) -> list[Rule]:
    """Rules of a moment that should not be older than a limit."""
    unseen, unlimited, late, fresh, state = WATCHES[name]
    old = age(at, now)
    return [(at.isNull(), "unknown", unseen, None), (limit.isNull(), "unknown", unlimited, old), (old > limit, "stale", late, old), (F.lit(True), state, fresh, old)]


def observed(rows: DataFrame, now: Column, **names: str) -> DataFrame:
    """``rows`` with the signals ``database, process, lock, progress, freshness``, each a column.

    Read are ``source`` (its state), ``available``, ``probed``, ``heartbeat``, ``heartbeat_limit``, ``lock`` (held, waiting,
    lost, or else not reported), ``lock_at``, ``lock_limit``, ``running``, ``started``, ``progress_at``, ``progress_limit``,
    ``run_state`` (of the latest run), ``success_at``, ``success_limit``; ``names`` gives columns of other names.
    """
    c = lambda name: F.col(names.get(name, name))
    off = [(c("source") != "active", c("source"), F.when(c("source") == "inactive", "source_inactive").otherwise("source_blocked"), None)]
    blind = [(~c("available") | c("probed").isNull(), "unknown", "database_unavailable", None)]
    held, waited = c("lock"), age(c("started"), now)
    seen, no_mark = age(c("lock_at"), now), c("progress_at").isNull()
    open_run = c("run_state").isin("incomplete", "backlogged", "parked", "unknown")
    tables = {
        "database": [
            (~c("available"), "unknown", "database_unavailable", age(c("probed"), now)),
            (c("probed").isNull(), "unknown", "probe_not_observed", None),
            (F.lit(True), "ok", "database_available", age(c("probed"), now)),
        ],
        "process": [*off, *blind, *watched("process", c("heartbeat"), c("heartbeat_limit"), now)],
        "lock": [
            *off,
            *blind,
            (held == "waiting", "failed", "waiting_for_advisory_lock", seen),
            (held == "lost", "failed", "lock_lost", seen),
            (~held.eqNullSafe("held"), "unknown", "lock_not_reported", seen),
            *watched("lock", c("lock_at"), c("lock_limit"), now),
        ],
        # Without a milestone the run's own start is what must not be too long ago.
        "progress": [
            *off,
            (~c("running"), "ok", "no_active_run", None),
            (no_mark & c("progress_limit").isNull(), "unknown", "progress_policy_unknown", None),
            (no_mark & (waited > c("progress_limit")), "stale", "first_progress_overdue", waited),
            *watched("progress", c("progress_at"), c("progress_limit"), now),
        ],
        "freshness": [
            *off,
            (open_run, F.when(c("run_state") == "unknown", "unknown").otherwise("stale"), F.concat(F.lit("current_run_"), c("run_state")), age(c("success_at"), now)),
            *watched("freshness", c("success_at"), c("success_limit"), now),
        ],
    }
    return rows.select("*", *(first_rule(rules).alias(f"_{name}") for name, rules in tables.items()))


def conclusion() -> Column:
    """``struct<state, reason, age>`` from the columns of :func:`observed`: the first row of ``CONCLUSIONS`` that speaks.

    An unknown policy is told by its own name.
    """
    rules: list[Rule] = [(F.col("source") != "active", F.col("source"), F.concat(F.lit("source_"), F.col("source")), None)]
    for name, state, verdict, reason in CONCLUSIONS:
        own = F.col(f"_{name}")
        policy = own["reason"].endswith("_policy_unknown")
        said = own["reason"] if reason is None else F.when(policy, own["reason"]).otherwise(reason)
        rules.append((own["state"] == state, verdict, said, own["age"]))
    return first_rule([*rules, (F.lit(True), "green", "healthy", None)])
