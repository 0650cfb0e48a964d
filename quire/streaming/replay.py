"""Streaming forms of the stateful rules; each gives the rows of its batch twin when events come in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quire.operators.limits import admit


def admission(events: DataFrame, window: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """Sliding-window admission of a stream of (event_id, user_id, t in microseconds): event_id, user_id, limited.

    The state of a key is the accepted times inside its window; it goes when the watermark, ``late`` behind the latest event, has left the last of them behind.
    """
    timed = events.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"], kind="stable")
        limited, _, held = admit(rows["t"].tolist(), window, limit, deque(state.get[0] if state.exists else []))
        state.update((list(held),))
        state.setTimeoutTimestamp(max((max(held, default=0) + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "limited": limited})

    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, limited boolean", "held array<long>", "append", "EventTimeTimeout")


def issued(events: DataFrame, key: str, at: str, late: str, span: str) -> DataFrame:
    """How many events of each key fall in each window of ``span``; windows are closed once the watermark passes them."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, span)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def credited_once(events: DataFrame, payment: str, at: str, late: str) -> DataFrame:
    """The first event of each payment that arrives while the watermark still covers it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([payment])


def sessions(events: DataFrame, key: str, at: str, late: str, gap: str) -> DataFrame:
    """Bursts of events of a key, closed after ``gap`` without one."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_end(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds and return what it put out; for replays whose output fits in memory."""
    out = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    out.awaitTermination()
    return rows.sparkSession.table(name)
