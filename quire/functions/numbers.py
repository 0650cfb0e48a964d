"""Arithmetic rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def spine_thickness(characters: Column, low: float = 150_000, high: float = 900_000) -> Column:
    """0.7 to 1.7, by the square root of the length between ``low`` and ``high``."""
    return 0.7 + F.sqrt(clamp((characters - low) / (high - low), 0.0, 1.0))


def spine_ratio(width: Column, height: Column) -> Column:
    """Width over height within 0.04 and 0.35; 1 / 5.3 where it is not known."""
    return F.when((width > 0) & (height > 0), clamp(width / height, 0.04, 0.35)).otherwise(F.lit(1 / 5.3))


def weighted_percent(before: Column, own: Column, total: Column, index: Column, chapters: Column, fraction: Column) -> Column:
    """Progress in a book whose chapters weigh by length (all alike if no length is known); ``index`` counts from 0."""
    f = clamp(fraction, 0.0, 1.0)
    weighted = F.when(total > 0, (before + f * own) / total).otherwise((index + f) / chapters)
    return F.when(chapters == 0, 0).otherwise(F.least(F.lit(100), F.round(weighted * 100))).cast("long")


def cloud_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time stamp that is UTC unless it says otherwise; 0 if it does not parse or is null."""
    zoned = F.when(ts.rlike(r"[Zz]$|[+-]\d{2}:\d{2}$"), ts).otherwise(F.concat(F.replace(ts, F.lit(" "), F.lit("T")), F.lit("Z")))
    return F.coalesce(F.unix_millis(F.try_to_timestamp(zoned)), F.lit(0))


def backoff_seconds(attempt: Column, first: float, base: float) -> Column:
    return F.lit(first) * F.pow(F.lit(base), attempt)


#: Codes of ``progress_fault``, in the order of the checks.
FAULTS = ["progress out of range", "chapter below 1", "xpath too long", "coordinate out of range", "label too long"]


def progress_fault(progress: Column, chapter: Column, xpath: Column, row: Column, col: Column, label: Column) -> Column:
    """What is wrong with an update, or null."""
    checks = [~progress.between(0, 100), chapter < 1, F.length(xpath) > 500, (F.abs(row) > 50) | (F.abs(col) > 50), F.length(label) > 60]
    return F.coalesce(*[F.when(c, text) for c, text in zip(checks, FAULTS)])
