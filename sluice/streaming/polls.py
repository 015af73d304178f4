"""Missed polls as a keyed state over a stream: the same counts as ``history.missed_polls`` gives over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.history import MISSED
from sluice.shipping import ship


def missed_polls(polls: DataFrame) -> DataFrame:
    """``key, poll, missed, status`` after each poll of ``key, poll, seen, complete``; a key's state is one number.

    Polls of a key must arrive in order across batches; inside a batch they are sorted here.
    """
    ship(polls.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("poll")
        out = []
        for poll, seen, complete in zip(rows["poll"], rows["seen"], rows["complete"]):
            missed = 0 if seen else min(missed + bool(complete), MISSED + 1)
            out.append((key[0], poll, missed, "stale" if missed >= MISSED else "active"))
        state.update((missed,))
        yield pd.DataFrame(out, columns=["key", "poll", "missed", "status"])

    return polls.groupBy("key").applyInPandasWithState(step, "key long, poll long, missed long, status string", "missed long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, size: str, late: str) -> DataFrame:
    """Counts by tumbling event-time window; what is later than ``late`` is dropped when the window has closed."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
