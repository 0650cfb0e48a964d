"""Admission and time: sliding windows, caps, single use, debouncing, validity."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import known, ordered_fold
from quire.operators.segmentation import Rule, segmented
from quire.operators.speculation import speculated


def admit(times: list[int], window: int, limit: int, held: deque | None = None) -> tuple[list[bool], list[int], deque]:
    """Whether each of the ordered times is limited, how many accepted ones its window held, and what is held after the last.

    At the limit an event is refused and does not count, so refused events never prolong a block.
    """
    held = deque() if held is None else held
    limited, current = [], []
    for t in times:
        while held and t - held[0] >= window:
            held.popleft()
        full = len(held) >= limit
        if not full:
            held.append(t)
        limited.append(full)
        current.append(len(held))
    return limited, current, held


def sliding_window(events: DataFrame, key: str, micros: str, order: str, window: int, limit: int, hot_rows: int | None = None) -> DataFrame:
    """events with ``limited`` and ``current``.  Times are microseconds; ``order`` breaks ties.

    A key's events are folded in order, since a refusal depends on earlier ones; the state is its accepted events inside one window.  A key of more than ``hot_rows``
    events is folded in bins from guessed states, which are made good (``operators/speculation.py``).
    """

    def step(held: deque, t: int) -> tuple:
        limited, current, held = admit([t], window, limit, held)
        return held, (limited[0], current[0])

    def begin(held: deque | None, t: int, entering: str) -> tuple:
        return step(deque(json.loads(entering)) if held is None else held, t)

    def fold(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered_fold(part, keys, [micros, order], [micros, "entering"], lambda: None, begin, "limited boolean, current bigint")

    return speculated(events, [key], [micros, order], [micros], deque, step, fold, hot_rows, load=lambda s: deque(json.loads(s)), dump=lambda held: json.dumps(list(held)))


def issuance_counters(codes: DataFrame, now: Column, address: str, ip: str) -> DataFrame:
    """Five counters in one scan, as of ``now``: of the key in 15 minutes and a day, of the address in an hour and a day, of all in a day."""
    since = lambda span: F.col("created_at") > now - F.expr(f"INTERVAL {span}")
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    own, here = F.col("abuse_key") == address, F.col("ip") == ip
    return codes.where(F.col("created_at") <= now).agg(
        n(own & since("15 minutes"), "key_15m"), n(own & since("1 day"), "key_day"), n(here & since("1 hour"), "ip_hour"), n(here & since("1 day"), "ip_day"), n(since("1 day"), "all_day")
    )


#: Counter, its cap, and the answer to a request at the cap.
CAPS = [("key_15m", 3, 429), ("key_day", 10, 429), ("ip_hour", 6, 429), ("ip_day", 20, 429), ("all_day", 300, 503)]


def issuance_answer() -> Column:
    """The answer to a request after ``issuance_counters``: 200, or that of the first cap reached."""
    return F.coalesce(*[F.when(F.col(name) >= cap, code) for name, cap, code in CAPS], F.lit(200))


def valid_code(codes: DataFrame, now: Column, attempts: int = 5) -> DataFrame:
    """The newest code of each address that is not used, expired or tried too often."""
    rows = codes.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now) & (F.col("attempts") < attempts))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("email").orderBy(F.desc("created_at"), F.desc("id")))).where("n = 1").drop("n")


def consumed_once(claims: DataFrame, key: str, order: list[str]) -> DataFrame:
    """claims with ``won``: the first claim of each code consumes it, later ones fail."""
    return claims.withColumn("won", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def debounced(events: DataFrame, key: str, at: str, order: list[str], quiet: str) -> DataFrame:
    """The events that no other of their key follows within ``quiet``."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, *order))
    return events.withColumn("following", following).where(F.col("following").isNull() | (F.col("following") >= F.col(at) + F.expr(f"INTERVAL {quiet}"))).drop("following")


def throttled(events: DataFrame, key: str, micros: str, order: str, gap: int, hot_rows: int | None = None) -> DataFrame:
    """The polls that go out: the first, and those at least ``gap`` microseconds after the last that did.  A key of more than ``hot_rows`` events is folded in bins."""

    def step(last: float | None, t: int, entering: float | None, before: int) -> tuple:
        last = last if last is not None else None if known(entering) is None else -int(entering)
        sent = last is None or t - last >= gap
        return (t if sent else last), (sent,)

    def fold(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered_fold(part, keys, [micros, order], [micros, "entering", "before"], lambda: None, step, "sent boolean")

    # A poll that went out takes in those of the gap after it; what it hands on is its time, below zero.
    rule = Rule(lambda t: (t, t, 0), gap - 1)
    return segmented(events, [key], [micros, order], [micros], rule, "bigint", fold, "sent boolean", hot_rows).where("sent").drop("sent")


def within_tolerance(sent: Column, now: Column, seconds: int = 300) -> Column:
    """Whether a signed message is neither too old nor from the future."""
    return F.abs(F.unix_seconds(now) - F.unix_seconds(sent)) <= seconds


def first_seen_until(events: DataFrame, key: str, at: str, span: str) -> DataFrame:
    """events with ``refreshing``: whether they are within ``span`` of the key's first."""
    return events.withColumn("refreshing", F.col(at) < F.min(at).over(Window.partitionBy(key)) + F.expr(f"INTERVAL {span}"))
