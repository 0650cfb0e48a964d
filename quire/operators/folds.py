"""Greedy folds over ordered rows: batches by a budget and packing of shelves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.segmentation import Rule, hot_keys, segmented
from quire.staging import staged


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable, step: Callable, outputs: str) -> DataFrame:
    """rows with ``outputs``: what ``step(state, *values)`` returns besides the next state, row by row in ``order`` for each key, from ``start()`` on.

    Keys are dealt to tasks and sorted by Spark, which spills; a task holds one batch of rows and the state of one key, however many rows the key has.
    """
    schema = StructType([*rows.schema, *StructType.fromDDL(outputs)])
    names = [f.name for f in StructType.fromDDL(outputs)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            of_keys = zip(*[[None if x != x else x for x in batch[k].tolist()] for k in keys])
            for key, value in zip(of_keys, zip(*[batch[v].tolist() for v in values])):
                if state is None or key != at:
                    at, state = key, start()
                state, made = step(state, *value)
                out.append(made)
            yield batch.assign(**dict(zip(names, zip(*out)))) if out else batch.assign(**{n: [] for n in names})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def batches(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, hot_rows: int | None = None) -> DataFrame:
    """rows with ``batch`` (from 1) and ``batch_size`` so far: a row opens a new batch if the open one is not empty and would exceed the budget.

    An oversize row so gets a batch of its own, and a missing size counts as 0.  Each key is folded by itself, one of more than ``hot_rows`` rows in bins.
    """

    def step(state: tuple | None, x: int, entering: float | None, before: int) -> tuple:
        batch, full = state or (before, entering)
        x = int(known(x) or 0)
        full = known(full)
        batch, full = (batch + 1, x) if full is None or full + x > budget else (batch, int(full) + x)
        return (batch, full), (batch, full)

    def fold(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered_fold(part, keys, order, [size, "entering", "before"], lambda: None, step, outputs)

    def loads(sizes: np.ndarray) -> tuple:
        own = np.nan_to_num(sizes.astype(np.float64)).astype(np.int64) if sizes.dtype.kind != "i" else sizes.astype(np.int64)
        sums = np.cumsum(own)
        return sums, sums - own, int(sums[-1])

    outputs = "batch bigint, batch_size bigint"
    return segmented(rows, keys, order, [size], Rule(loads, budget), "bigint", fold, outputs, hot_rows)


def packed(rows: DataFrame, keys: list[str], group: str, order: list[str], width: str, capacity: float, gap: float = 0.0, hot_rows: int | None = None) -> DataFrame:
    """rows with ``shelf_row`` (from 0) and ``x``: books side by side, wrapped where one would not fit; each group starts on a fresh row.

    Keys of more than ``hot_rows`` rows are packed group by group, groups of as many in bins, and each group starts after the rows of those before it.
    """
    most = float(capacity) + 1e-6

    def step(state: tuple, name: str, w: float) -> tuple:
        row, x, last = state
        if row < 0 or name != last or (x > 0 and x + w > most):
            row, x = row + 1, 0.0
        return (row, x + w + gap, name), (row, x)

    def in_group(state: tuple | None, w: float, entering: float | None, before: int) -> tuple:
        row, x = state or (before - 1, known(entering))
        if x is None or (x > 0 and x + w > most):
            row, x = row + 1, 0.0
        return (row, x + w + gap), (row, x)

    def fold(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered_fold(part, keys, order, [width, "entering", "before"], lambda: None, in_group, outputs)

    def loads(w: np.ndarray) -> tuple:
        sums = np.cumsum(w + gap)
        return sums - gap, sums - w - gap, float(sums[-1])

    outputs = "shelf_row bigint, x double"
    hot = hot_keys(rows, keys, hot_rows)
    if hot.isEmpty():
        return ordered_fold(rows, keys, [group, *order], [group, width], lambda: (-1, 0.0, None), step, outputs)
    # Hot keys are at most a row for each hot_rows rows.
    listed = F.broadcast(hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys]))
    match = [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]
    cold = ordered_fold(rows.join(listed, match, "left_anti"), keys, [group, *order], [group, width], lambda: (-1, 0.0, None), step, outputs)
    own = staged(segmented(rows.join(listed, match, "left_semi"), [*keys, group], order, [width], Rule(loads, most, empty_takes=True), "double", fold, outputs, hot_rows))
    per = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    tall = own.groupBy(*keys, group).agg((F.max("shelf_row") + 1).alias("tall"))
    above = tall.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, group)], F.coalesce(F.sum("tall").over(per), F.lit(0)).alias("above"))
    placed = own.join(above, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*keys, group)])
    return cold.unionByName(placed.withColumn("shelf_row", F.col("shelf_row") + F.col("above")).select(*cold.columns))


def known(x: float | None) -> float | None:
    """x, or None for what pandas has for a missing number."""
    return None if x is None or x != x else x
