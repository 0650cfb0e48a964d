"""States of jobs as a stream: the latest state of each job, transitions that may not be, jobs that run out of time and jobs that nothing touches.

The streaming form of ``operators.jobs``: a job's events go to its own state, whose timers ring in event time.  A job that has ended keeps its state until ``keep`` after its
last event, so that late events do not open it anew, and then it goes.  State lives in RocksDB, which the session must have as its state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.jobs import FINAL, STATES

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "job_id long, note string, status string, events long, at timestamp"


def may_follow(before: str, status: str) -> bool:
    """Forward by one or more, or to error; never out of a final state."""
    return before not in FINAL and (status == "error" or (status in STATES and before in STATES and STATES.index(status) > STATES.index(before)))


class Jobs(StatefulProcessor):
    """Rows of (job_id, note, status, events, at): a ``state`` for each batch of events of a job, ``illegal`` for each transition that may not be, ``timed out``, ``stalled``."""

    def __init__(self, limit: int, idle: int, keep: int):
        self.limit, self.idle, self.keep = limit, idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Of the job: its latest event, how many there were, when the first and the latest came, what its timers wait for.
        self.job = handle.getValueState("job", "status string, event long, events long, first long, last long")
        #: Transitions that may not be, for whoever looks into the state.
        self.illegal = handle.getListState("illegal", "before string, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ms", "event_id"], kind="stable")
        status, event, events, first, last = self.job.get() if self.job.exists() else (None, None, 0, None, None)
        out, refused = [], []
        for ms, own, now in zip(new["ms"].tolist(), new["event_id"].tolist(), new["status"].tolist()):
            events += 1
            first = ms if first is None else min(first, ms)
            # An event older than the latest one counts, but does not change the state.
            if last is None or (ms, own) > (last, event):
                if status is not None and not may_follow(status, now):
                    refused.append((status, now))
                    out.append((key[0], "illegal", now, events, ms))
                status, event, last = now, own, ms
        self.job.update((status, event, events, first, last))
        if refused:
            self.illegal.appendList(refused)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        ahead = max(timerValues.getCurrentWatermarkInMs() + 1, 1)
        if status in FINAL:
            self.handle.registerTimer(max(last + self.keep, ahead))
        else:
            self.handle.registerTimer(max(first + self.limit + 1, ahead))
            self.handle.registerTimer(max(last + self.idle + 1, ahead))
        out.append((key[0], "state", status, events, last))
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, _, events, first, last = self.job.get()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if status in FINAL:
            self.job.clear(), self.illegal.clear()
        else:
            if now > last + self.idle:
                out.append((key[0], "stalled", status, events, last))
            if now > first + self.limit:
                out.append((key[0], "timed out", status, events, last))
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["job_id", "note", "status", "events", "at"])
    return frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))


def job_states(events: DataFrame, late: str = "0 seconds", limit: int = 4 * 3600_000, idle: int = 300_000, keep: int = 24 * 3600_000) -> DataFrame:
    """OUTPUT rows of a stream of (job_id, event_id, at timestamp, status); times are milliseconds, ``late`` is how far the watermark stays behind."""
    timed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).select("job_id", "event_id", "status", "ms", "at")
    return timed.groupBy("job_id").transformWithStateInPandas(Jobs(limit, idle, keep), OUTPUT, "Append", "EventTime")
