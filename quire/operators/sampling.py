"""Ordered neighbours and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranks import carried, numbered


def context(rows: DataFrame, keys: list[str], order: list[str], text: str, before: int = 2, after: int = 2) -> DataFrame:
    """rows with ``context_before`` and ``context_after``, arrays of the neighbours' texts in order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("context_before", F.collect_list(text).over(at.rowsBetween(-before, -1)))
    return rows.withColumn("context_after", F.collect_list(text).over(at.rowsBetween(1, after)))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Every step-th row from the first on, step = max(1, floor(n / k)), the first k of those."""
    rows = numbered(rows, keys, order)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return rows.where((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < k)).drop("at", "n")


def head_middle_tail(rows: DataFrame, keys: list[str], order: list[str], head: int, middle: int, tail: int) -> DataFrame:
    """The first, middle and last rows with ``part``; a row in several parts is there once for each."""
    rows = numbered(rows, keys, order)
    start = F.greatest(F.lit(0), F.floor(F.col("n") / 2) - middle // 2)
    parts = F.array_compact(F.array(
        F.when(F.col("at") < head, "head"), F.when((F.col("at") >= start) & (F.col("at") < start + middle), "middle"), F.when(F.col("at") >= F.col("n") - tail, "tail")
    ))
    return rows.withColumn("part", F.explode(parts)).drop("at", "n")


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], setter: Column) -> DataFrame:
    """rows with ``carried``: the last value set at or before them."""
    return carried(rows, keys, order, setter, "carried")


def running_number(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """rows with ``number``: how many rows so far start something; null before the first."""
    n = F.sum(F.when(starts, 1)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", n)


def first_of_each(rows: DataFrame, value: list[str], order: list[str]) -> DataFrame:
    """Rows without those that repeat an earlier value."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*value).orderBy(*order))).where("n = 1").drop("n")
