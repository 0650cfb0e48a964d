"""Jobs over chapters: planning, completeness, resuming, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a job in the order that they may follow each other, and those that are final.
STATES = ["pending", "extracting_glossary", "translating", "completed", "error"]
FINAL = ["completed", "error"]
FAILED_MARK = "[Translation failed]"


def counted(units: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """units with ``found``, the number of rows of each, 0 where there are none."""
    n = rows.groupBy(F.col(key).alias("count_of")).agg(F.count("*").alias("n"))
    return units.join(n, F.col(key) == F.col("count_of"), "left").select(*units.columns, F.coalesce("n", F.lit(0).cast("long")).alias("found"))


def planned(units: DataFrame, expected: str, found: str = "found") -> DataFrame:
    """units with ``plan``: complete, pending (nothing there yet) or partial (to be wiped and done again); units that expect nothing are complete."""
    state = F.when(F.col(expected) == F.col(found), "complete").when(F.col(found) == 0, "pending").otherwise("partial")
    return units.withColumn("plan", F.when(F.col(expected) == 0, "complete").otherwise(state))


def wiped(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """rows without those of partial units."""
    return rows.join(plan.where(F.col("plan") == "partial").select(key), key, "left_anti")


def missing(units: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Units that no row is there for."""
    return units.join(rows.select(*keys), keys, "left_anti")


def finalize(planned_units: DataFrame, keys: list[str]) -> DataFrame:
    """For each book: incomplete units, expected and found rows, and what keeps it from being finished (null if nothing does)."""
    sums = planned_units.groupBy(*keys).agg(
        F.sum(F.when(F.col("plan") != "complete", 1).otherwise(0)).alias("incomplete"), F.sum("expected").cast("long").alias("expected"), F.sum("found").cast("long").alias("found")
    )
    return sums.withColumn("fault", F.when(F.col("incomplete") > 0, "incomplete chapters").when((F.col("expected") == 0) & (F.col("found") == 0), "empty book"))


def stalled(jobs: DataFrame, active: DataFrame, now: Column, n: int, idle: str = "5 minutes", owner: str | None = None) -> DataFrame:
    """The n oldest of the unfinished jobs that nothing has touched for ``idle`` and that are not active, in the order of ``turn``."""
    rows = jobs.where(~F.col("status").isin(FINAL) & (F.col("updated_at") < now - F.expr(f"INTERVAL {idle}")))
    if owner is not None:
        rows = rows.where(F.col("backend") == owner)
    rows = rows.join(active.select("job_id"), "job_id", "left_anti")
    rows = rows.orderBy("updated_at", "job_id").limit(n)
    return rows.withColumn("turn", F.row_number().over(Window.orderBy("updated_at", "job_id")))


def backend(requested: Column) -> Column:
    return F.when(requested == "cf", "cf").otherwise("railway")


def routed(flag: Column, user: Column, allowed: list[int], default: Column) -> Column:
    """Which backend a job goes to: an explicit flag, else the list of users, else the default."""
    return F.coalesce(flag, F.when(user.isin(allowed), "cf"), default)


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count("*").alias("events"))


def transitions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """How often a status follows another for the same job, and whether it may: forward by one or more, or to error; never out of a final state."""
    at = Window.partitionBy(key).orderBy(*order)
    pairs = events.withColumn("before", F.lag("status").over(at)).where(F.col("before").isNotNull())
    place = lambda c: F.array_position(F.lit(STATES), F.col(c))
    legal = ~F.col("before").isin(FINAL) & ((F.col("status") == "error") | (place("status") > place("before")))
    return pairs.groupBy("before", "status").agg(F.count("*").alias("n")).withColumn("legal", legal)


def chunk_slices(nodes: DataFrame, keys: list[str], order: str, size: int = 25) -> DataFrame:
    """nodes with ``chunk``, the number of the call that works on them: up to ``size`` nodes of one chapter."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return nodes.withColumn("chunk", F.floor(at / size).cast("long"))


def timed_out(jobs: DataFrame, now: Column, limit: str = "4 hours") -> DataFrame:
    return jobs.withColumn("timed_out", ~F.col("status").isin(FINAL) & (F.col("created_at") < now - F.expr(f"INTERVAL {limit}")))


def book_status(asked: DataFrame, books: DataFrame, jobs: DataFrame) -> DataFrame:
    """asked (uuid, reader) with ``answer`` (404 for books that are not there or not the reader's to see, else 200), ``status`` and, of a book in processing, where its
    first job is: ``phase``, ``completed``, ``total``, ``current``.
    """
    own = books.select(F.col("uuid").alias("of"), "user_id", F.col("status").alias("book_status"))
    first = jobs.groupBy(F.col("book_uuid").alias("job_of")).agg(F.min_by(F.struct("status", "completed_chapters", "total_chapters", "current_chapter"), "id").alias("job"))
    rows = asked.join(own, F.col("uuid") == F.col("of"), "left").join(first, F.col("uuid") == F.col("job_of"), "left")
    seen = F.col("of").isNotNull() & (F.col("user_id").isNull() | F.coalesce(F.col("user_id") == F.col("reader"), F.lit(False)))
    busy = seen & (F.col("book_status") == "processing")
    of = lambda c: F.when(busy, F.col(f"job.{c}"))
    return rows.select(
        *asked.columns, F.when(seen, 200).otherwise(404).alias("answer"), F.when(seen, F.col("book_status")).alias("status"),
        of("status").alias("phase"), of("completed_chapters").alias("completed"), of("total_chapters").alias("total"), of("current_chapter").alias("current"),
    )


def has_artwork(cover: Column, spine: Column) -> Column:
    """Whether a book has both its pictures."""
    return F.coalesce(cover != "", F.lit(False)) & F.coalesce(spine != "", F.lit(False))


def import_states(status: Column, cover: Column, spine: Column, language_pair: Column) -> list[Column]:
    """``import_pending``, ``artwork_pending`` and ``needs_drive`` (a translation that the reader's page has to keep going) of a book."""
    processing = status.eqNullSafe(F.lit("processing"))
    artwork = ~status.eqNullSafe(F.lit("error")) & ~has_artwork(cover, spine)
    drive = processing & ~F.coalesce(language_pair.endswith("-none"), F.lit(False))
    return [processing.alias("import_pending"), artwork.alias("artwork_pending"), drive.alias("needs_drive")]
