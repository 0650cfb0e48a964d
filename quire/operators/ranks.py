"""Ranks and carried values inside keys that may hold a large share of all rows.

A window puts all rows of a key into one task.  Here rows are dealt by ranges of (key, order), which also cut through a key; ranks are counted inside (key, range), and
each range starts where those before it in its key end.  There are as many ranges as the session has shuffle partitions, so they follow the size of the cluster and its
input; a key that fits in one range stays in one.  How rows are dealt never decides a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import staged


def _struct(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])


def binned(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with ``__bin``: inside a key, a row's bin is not above that of any row after it in ``order`` (ascending, nulls first).  Written once, so that all steps see the same bins."""
    return staged(rows.repartitionByRange(*keys, *order).withColumn("__bin", F.spark_partition_id()))


def _joined(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of told that are not keys, matched by keys, null ones too."""
    of = told.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in told.columns if c not in keys])
    match = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return rows.join(of, match, "left").drop(*[f"__of_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with ``at``, from 0 in ``order`` inside each key, and ``n``, the rows of the key.  ``order`` must tell rows apart for ranks to be the same on each run."""
    parts = binned(rows, keys, order)
    counts = parts.groupBy(*keys, "__bin").agg(F.count("*").alias("__in_bin"))
    per = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__in_bin").over(per.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(*keys, "__bin", before.alias("__start"), F.sum("__in_bin").over(per).alias("n"))
    at = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(*order)) - 1 + F.col("__start")
    return _joined(parts, told, [*keys, "__bin"]).withColumn("at", at).drop("__bin", "__start")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with ``name``: the last value that is not null at or before them in ``order``, inside each key."""
    parts = binned(rows.withColumn(name, value), keys, order)
    last = F.max_by(F.when(F.col(name).isNotNull(), F.col(name)), F.when(F.col(name).isNotNull(), _struct([F.col(c) for c in order])))
    ends = parts.groupBy(*keys, "__bin").agg(last.alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    told = ends.select(*keys, "__bin", before.alias("__start"))
    own = F.last(name, ignorenulls=True).over(Window.partitionBy(*keys, "__bin").orderBy(*order))
    return _joined(parts, told, [*keys, "__bin"]).withColumn(name, F.coalesce(own, "__start")).drop("__bin", "__start")
