"""Curation as a stream: one state for each record, versions and events as they come.

Over observations that arrive in order the events are those of :func:`sluice.operators.history.curate` over the whole
table; the state of a record is one row, whatever the length of its history, and lives in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluice.shipping import ship

EVENTS = StructType([StructField("key", LongType()), StructField("position", LongType()), StructField("event", StringType()), StructField("version", LongType()), StructField("status", StringType())])
_STATE = "hash string, status string, version bigint, position bigint, timer bigint"
#: The store that keyed states need; the other one takes no timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Curator(StatefulProcessor):
    """The curation of one key: its last hash, status, version and position, and when it counts as silent."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _STATE)

    def _await(self, due: int | None, before: int | None) -> None:
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.record.exists()
        digest, status, version, last, timer = self.record.get() if known else (None, None, 0, None, None)
        before, out = timer, []
        arrived = pd.concat(list(rows)).sort_values("position", kind="stable")
        for position, own, said, at in zip(arrived["position"], arrived["hash"], arrived["status"], arrived["ms"]):
            if last is not None and position <= last:
                continue  # seen already, or overtaken
            own, said = (None if pd.isna(v) else v for v in (own, said))
            said = status if said is None else said
            event = "new" if not known else "changed" if own != digest else "status_changed" if said != status else None
            known, digest, status, last = True, own, said, int(position)
            if event:
                version += 1
                out.append((key[0], last, event, version, status))
            if self.silence_ms is not None:
                timer = None if status == "closed" else int(at) + self.silence_ms
        self._await(timer, before)
        if known:
            self.record.update((digest, status, version, last, timer))
        yield pd.DataFrame(out, columns=EVENTS.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        digest, status, version, last, timer = self.record.get()
        if timer is None or expiredTimerInfo.getExpiryTimeInMs() < timer or status in ("stale", "closed"):
            return
        self.record.update((digest, "stale", version + 1, last, None))
        yield pd.DataFrame([(key[0], last, "status_changed", version + 1, "stale")], columns=EVENTS.names)

    def close(self) -> None:
        pass


def curate(observations: DataFrame, silence: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``key, position, event, version, status`` of a stream of ``key, position, hash, status, at``: what changes a record.

    Events are ``new``, ``changed`` and ``status_changed``; an observation of null status keeps the one before it.  One that
    is not behind the last of its key changes nothing, so repeated ones write no event twice.  With ``silence`` (an
    interval of event time such as ``7 days``) a record that is neither seen nor closed for that long becomes
    ``stale`` when the watermark passes, and what is more than ``late`` behind the watermark is dropped.  Rows of a null
    key share one record.  The rows of a key in one batch are held together, so the source's batch size bounds them.
    """
    spark = observations.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = observations.select(F.col("key").cast("long"), F.col("position").cast("long"), F.col("hash").cast("string"), F.col("status").cast("string"), F.col("at").cast("timestamp"))
    rows = rows.withColumn("ms", F.unix_millis("at"))
    ms = None
    if silence is not None:
        ms = spark.range(1).select(((F.unix_micros(F.lit("2000-01-01").cast("timestamp") + F.expr(f"INTERVAL {silence}")) - F.unix_micros(F.lit("2000-01-01").cast("timestamp"))) / 1000).cast("long")).first()[0]
        rows = rows.withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Curator(ms), outputStructType=EVENTS, outputMode="Append", timeMode="None" if ms is None else "EventTime")
