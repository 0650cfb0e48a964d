"""Greedy segmentation of keys that are too large for one task.

A greedy rule opens a new segment at the first row that no longer fits in the open one, so all depends on what came before.  But what comes before a stretch of rows
acts on it only by how full the open segment is when the stretch begins: that decides the stretch's first new segment, and from there on all is settled.  So a key is
cut into bins of its order; each bin, by itself, maps every row that could be its first new segment to how full the last segment is when the bin ends and how many are
opened; a scan over the bins composes these maps; and each bin is then folded from its true state on, side by side with the others.

In a bin, the next segment of every row is found at once in prefix sums, and chains of segments are followed by pointer doubling.  The map is stored in steps, as rows
that lead to the same end are one; chains soon meet, so steps are few.  Sums of floats are formed bin by bin here and row by row in the fold, so a row that misses its
limit by no more than rounding may be taken either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.staging import staged

#: Keys with more rows are cut into bins; rows of a bin, about.
HOT_ROWS, BIN_ROWS = 1_000_000, 200_000
#: Bins whose entering states are broadcast; more are joined by a shuffle.
BROADCAST_BINS = 500_000


class Rule:
    """A greedy rule in numbers: a segment that starts at row s takes in row p as long as ``load[p] - base[s]`` is at most ``most``.

    ``loads(*values)`` gives load, base and the sum that the whole bin adds, of rows in order; load does not fall.  The open segment enters a bin as a number that is
    added to the loads.  With ``empty_takes``, a segment that adds up to nothing so far takes in whatever comes.
    """

    def __init__(self, loads: Callable, most: float, empty_takes: bool = False):
        self.loads, self.most, self.empty_takes = loads, most, empty_takes

    def following(self, load: np.ndarray, base: np.ndarray, most: float) -> np.ndarray:
        """For each row, the start of the next segment if one starts there; the number of rows if none does."""
        at = np.searchsorted(load, most + base, side="right")
        if self.empty_takes:
            at = np.maximum(at, np.searchsorted(base, base, side="right"))
        return np.maximum(at, np.arange(len(load)) + 1)

    def steps(self, *values: np.ndarray) -> dict:
        """A bin's map: for first segments up to row ``last``, whose load is ``load``, what leaves the bin and how many segments are opened."""
        load, base, total = self.loads(*values)
        n = len(load)
        to = np.append(self.following(load, base, self.most), n)
        first = int(to[0]) if n else 0
        # Pointer doubling: after k rounds, every row knows the segment that its chain reaches in 2**k steps, and how many it took.
        jump, count, last = to.copy(), np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
        while (jump[:n] < n).any():
            onward = jump < n
            last = np.where(onward, last[jump], last)
            count = np.where(onward, count + count[jump], count)
            jump = jump[jump]
        leaves = np.append(total - base, 0)[last]
        reach = np.arange(min(first, n - 1) + 1) if n else np.arange(0)
        new = np.flatnonzero((np.diff(leaves[reach]) != 0) | (np.diff(count[reach]) != 0))
        ends = np.append(new, len(reach) - 1) if len(reach) else new
        return {
            "last": ends, "load": load[reach[ends]], "leaves": leaves[reach[ends]], "opened": count[reach[ends]], "total": total,
            "least": int(np.searchsorted(base, base[0], side="right")) if self.empty_takes and n else 0,
        }

    def passed(self, state: float | None, step: dict) -> tuple[float, int]:
        """What leaves a bin that ``state`` has entered (None: no open segment), and how many segments are opened in it."""
        if state is None:
            at = 0
        else:
            at = int(np.searchsorted(step["load"], self.most - state, side="right"))
            if self.empty_takes and state == 0:
                at = max(at, int(np.searchsorted(step["last"], step["least"], side="left")))
        if at == len(step["load"]):
            return state + step["total"], 0
        return float(step["leaves"][at]) if isinstance(self.most, float) else int(step["leaves"][at]), int(step["opened"][at])


def hot_keys(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys and ``n`` of the keys with more rows than ``most``, of which there are never more than rows / most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > (HOT_ROWS if most is None else most))


def split_hot(rows: DataFrame, keys: list[str], order: list[str], hot_rows: int | None) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of keys that are not hot; those of hot keys with ``hot`` (the key's number) and ``bin``, written, or None; and how many pairs of key and bin there can be."""
    hot = hot_keys(rows, keys, hot_rows).collect()
    if not hot:
        return rows, None, 0
    of = StructType([*[rows.schema[k] for k in keys]]).add("hot", "integer")
    listed = F.broadcast(rows.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(hot)], of).withColumnsRenamed({k: f"hot_{k}" for k in keys}))
    match = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
    bins = max(1, -(-sum(r["n"] for r in hot) // BIN_ROWS))
    own = rows.join(listed, match).select(*rows.columns, "hot")
    return rows.join(listed, match, "left_anti"), staged(own.repartitionByRange(bins, "hot", *order).withColumn("bin", F.spark_partition_id())), bins + len(hot)


def _summaries(rule: Rule, values: list[str], number: str) -> tuple[Callable, str]:
    schema = f"hot int, bin int, last array<bigint>, load array<{number}>, leaves array<{number}>, opened array<bigint>, total {number}, least bigint"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def made() -> pd.DataFrame:
            step = rule.steps(*[np.concatenate([h[i] for h in held]) for i in range(len(values))])
            row = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in step.items()}
            return pd.DataFrame([{"hot": at[0], "bin": at[1], **row}])

        for batch in batches:
            edges = np.flatnonzero((np.diff(batch["hot"]) != 0) | (np.diff(batch["bin"]) != 0)) + 1
            for part in np.split(np.arange(len(batch)), edges):
                if not len(part):
                    continue
                own = batch.iloc[part]
                if at is not None and (own["hot"].iloc[0], own["bin"].iloc[0]) != at:
                    yield made()
                    held = []
                at = own["hot"].iloc[0], own["bin"].iloc[0]
                held.append([own[v].to_numpy() for v in values])
        if at is not None:
            yield made()

    return run, schema


def _scan(rule: Rule, number: str) -> tuple[Callable, str]:
    """Bins in order: what enters each, and how many segments were opened before it; only one bin's map is held."""
    schema = f"hot int, bin int, entering {number}, before bigint"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, state, before = None, None, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.hot != hot:
                    hot, state, before = row.hot, None, 0
                out.append((row.hot, row.bin, state, before))
                step = {k: np.asarray(getattr(row, k)) for k in ("last", "load", "leaves", "opened")} | {"total": row.total, "least": row.least}
                state, opened = rule.passed(state, step)
                before += opened
            yield pd.DataFrame(out, columns=["hot", "bin", "entering", "before"]).astype({"entering": "float64" if number == "double" else "Int64"})

    return run, schema


def segmented(rows: DataFrame, keys: list[str], order: list[str], values: list[str], rule: Rule, number: str, fold: Callable, outputs: str, hot_rows: int | None = None) -> DataFrame:
    """rows with ``outputs`` of ``fold(rows, keys, values)``, which folds each of ``keys`` in ``order``; keys with many rows over many tasks.

    The fold is given the columns ``entering`` (how full the open segment is when a key's, or a bin's, first row comes; null where there is none) and ``before`` (how
    many segments there are already).  ``number`` is the type of sums, bigint or double.
    """
    fresh = [F.lit(None).cast(number).alias("entering"), F.lit(0).cast("bigint").alias("before")]
    columns = [*rows.columns, *StructType.fromDDL(outputs).names]
    cold, own, bins = split_hot(rows, keys, order, hot_rows)
    cold = fold(cold.select("*", *fresh), keys).select(*columns)
    if own is None:
        return cold
    sums, schema = _summaries(rule, values, number)
    maps = own.select("hot", "bin", *dict.fromkeys([*order, *values])).repartition("hot", "bin").sortWithinPartitions("hot", "bin", *order).mapInPandas(sums, schema)
    scan, schema = _scan(rule, number)
    entering = staged(maps.repartition("hot").sortWithinPartitions("hot", "bin").mapInPandas(scan, schema))
    # One row a bin and hot key; both were counted.
    entering = F.broadcast(entering) if bins <= BROADCAST_BINS else entering
    return cold.unionByName(fold(own.join(entering, ["hot", "bin"]), ["hot", "bin"]).select(*columns))
