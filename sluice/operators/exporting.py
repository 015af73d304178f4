"""Snapshots of selections, their approval, and the plan of an export."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def snapshot(matched: DataFrame, order: list[Column], most: int = 100) -> DataFrame:
    """One row: the ordered ids of a selection of at most ``most`` rows, with a digest of them."""
    top = matched.orderBy(*order).limit(most).select("id").withColumn("_n", F.monotonically_increasing_id())
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"])
    return top.agg(ids.alias("ids")).withColumn("digest", F.sha2(F.to_json("ids"), 256))


def approval(snapshots: DataFrame, approvals: DataFrame, now: str) -> DataFrame:
    """``id, verdict``: whether the approval of a snapshot binds it - first failing check, else ``approved``."""
    a = approvals.select(F.col("snapshot").alias("id"), F.col("ids").alias("approved_ids"), F.col("scope").alias("approved_scope"), "expires")
    joined = snapshots.join(a, "id", "left")
    verdict = (
        F.when(F.col("approved_ids").isNull(), "missing")
        .when(F.col("approved_scope") != F.col("scope"), "wrong_scope")
        .when(F.col("approved_ids") != F.col("ids"), "ids_differ")
        .when(F.col("expires") <= F.lit(now).cast("timestamp_ntz"), "expired")
        .otherwise("approved")
    )
    return joined.select("id", verdict.alias("verdict"))


def export_plan(wanted: DataFrame, ledger: DataFrame, target: str, action: str) -> DataFrame:
    """``id, key, plan`` by what the ledger holds under the idempotency key: confirmed is skipped, uncertain fails, the rest is created."""
    key = F.concat_ws(":", F.lit(target), F.col("id").cast("string"), F.lit(action))
    joined = wanted.select("id", key.alias("key")).join(ledger.select("key", "state"), "key", "left")
    return joined.select("id", "key", F.when(F.col("state") == "confirmed", "skip").when(F.col("state") == "uncertain", "fail").otherwise("create").alias("plan"))


def capped(rows: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows of an ad-hoc result and whether there were more."""
    some = rows.limit(cap + 1)
    return some.limit(cap), some.agg((F.count("*") > cap).alias("truncated"))


# Ad-hoc queries with limits


@dataclass(frozen=True)
class Answer:
    """What an ad-hoc query gave: rows up to the cap and whether there were more, or the reason why it gave none."""

    columns: list[str]
    rows: list[Row]
    truncated: bool = False
    reason: str | None = None


def dry_run(spark: SparkSession, sql: str) -> list[str]:
    """The plan of a query without running it: it is analysed and optimised, so names and types are checked. Errors are Spark's."""
    plan = spark.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line]


def ask(spark: SparkSession, sql: str, cap: int = 1000, seconds: float = 30.0) -> Answer:
    """Run an ad-hoc query with at most ``cap`` rows and ``seconds`` of time.

    One more row than the cap is fetched, so ``truncated`` is exact.  The jobs of a query carry a tag of their own, by which
    they are cancelled when the time is over; others go on.  A task ends with the batch of rows it is in.  ``reason`` is ``timeout``, or the message of
    Spark's error; permissions belong to the catalog.
    """
    context, tag, late = spark.sparkContext, f"ask-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        asked = spark.sql(sql)
        rows = asked.limit(cap + 1).collect()  # a known number of rows
        if late.is_set():
            return Answer(asked.columns, [], reason="timeout")
        return Answer(asked.columns, rows[:cap], len(rows) > cap)
    except Exception as error:
        if late.is_set():
            return Answer([], [], reason="timeout")
        if not isinstance(error, PySparkException):
            raise
        return Answer([], [], reason=str(error).splitlines()[0])
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def tables(spark: SparkSession, database: str = "default") -> dict[str, list[tuple[str, str, bool]]]:
    """Tables and views of a database with ``name, type, nullable`` of their columns."""
    found = spark.catalog.listTables(database)
    return {t.name: [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")] for t in sorted(found, key=lambda t: t.name)}
