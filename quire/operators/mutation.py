"""Updates as functions from old rows and changes to new rows; Parquet tables are replaced, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with the rows of changes put in by key; columns in ``keep`` hold their old value where the change has none.

    Keys of ``changes`` are unique; columns that it lacks stay, and are null in new rows.
    """
    new = changes.select([F.col(c).alias(f"new_{c}") for c in changes.columns])
    rows = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys], "full")
    pick = lambda c: F.col(c) if c not in changes.columns else F.when(F.col("is"), F.coalesce(f"new_{c}", c) if c in (keep or []) or c in keys else F.col(f"new_{c}")).otherwise(F.col(c))
    return rows.select(*[pick(c).alias(c) for c in old.columns])


def completed(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Completion flags: ``completed_at`` is set with the first completion, kept by later ones and cleared when a book is no longer completed."""
    new = changes.select(*[F.col(k).alias(f"new_{k}") for k in keys], F.col("is_completed").alias("new_done"), F.col("at").alias("new_at"))
    rows = old.join(new, [F.col(k) == F.col(f"new_{k}") for k in keys], "full")
    at = F.when(F.col("new_done").isNull(), F.col("completed_at")).when(F.col("new_done") == 1, F.coalesce("completed_at", "new_at"))
    return rows.select(*[F.coalesce(k, f"new_{k}").alias(k) for k in keys], F.coalesce("new_done", "is_completed").alias("is_completed"), at.alias("completed_at"))


def insert_ignore(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of rows whose key is not there yet; of equal new keys one stays."""
    return old.unionByName(rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_by_key(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of rows, and rows."""
    return old.join(rows.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*rows.columns)


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame, parents: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The tables without ``doomed`` (ids of the first parent) and all that hangs on it; parents are (table, id, parent table, reference), parents first."""
    gone: dict[str, DataFrame] = {}
    out = dict(tables)
    for name, key, parent, reference in parents:
        if parent == "":
            gone[name] = doomed.select(F.col(key).alias("gone"))
        else:
            gone[name] = tables[name].join(gone[parent], F.col(reference) == F.col("gone"), "left_semi").select(F.col(key).alias("gone"))
        out[name] = tables[name].join(gone[name], F.col(key) == F.col("gone"), "left_anti")
    return out


def set_columns(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """rows with the given columns set where the condition holds."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) if c in rows.columns else F.when(where, v) for c, v in values.items()})


def with_existence(rows: DataFrame, probe: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the boolean ``name``: whether ``probe`` has a row with the same keys; however many it has, a row stays one.  Null keys have none."""
    there = probe.select(*[F.col(k).alias(f"__of_{k}") for k in keys]).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, [F.col(k) == F.col(f"__of_{k}") for k in keys], "left").select(*rows.columns, F.coalesce("__there", F.lit(False)).alias(name))


def remapped(rows: DataFrame, old: DataFrame, new: DataFrame, reference: str, key: str, through: list[str], required: bool) -> DataFrame:
    """rows whose reference to old ids is turned to new ids through natural keys; those without a new id are an error to the caller (dropped) or null."""
    pairs = old.select(F.col(key).alias("old_id"), *through).join(new.select(F.col(key).alias("new_id"), *through), through).select("old_id", "new_id")
    joined = rows.join(pairs, F.col(reference) == F.col("old_id"), "inner" if required else "left")
    return joined.select(*[F.col("new_id").alias(c) if c == reference else F.col(c) for c in rows.columns])


def guarded_change(rows: DataFrame, user: int) -> DataFrame:
    """rows with ``refusal``: why the user may not change them, or null."""
    return rows.withColumn("refusal", F.when(F.col("user_id").isNull(), "public").when(F.col("user_id") != user, "not the owner"))


def migrated_labels(slots: DataFrame, placements: DataFrame, books: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Slots that hold a public book become public; labels of the others move to the users whose books they hold, and are cleared there."""
    held = placements.select("slot_id", "book_id").join(books.select(F.col("id").alias("book_id"), F.col("user_id").alias("owner")), "book_id")
    public = held.where(F.col("owner").isNull()).select(F.col("slot_id").alias("id")).distinct().withColumn("holds_public", F.lit(1))
    marked = slots.drop("is_public").join(public, "id", "left").withColumn("is_public", F.coalesce("holds_public", F.lit(0))).drop("holds_public")
    private = marked.where((F.col("is_public") == 0) & F.col("label").isNotNull()).select(F.col("id").alias("slot_id"), "label")
    moved = held.where(F.col("owner").isNotNull()).join(private, "slot_id").select(F.col("owner").alias("user_id"), "slot_id", "label").distinct()
    cleared = set_columns(marked, F.col("is_public") == 0, {"label": F.lit(None).cast("string")})
    return {"slots": cleared, "labels": insert_ignore(labels, moved, ["user_id", "slot_id"])}


def upsert_or_delete(old: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """old with the values of changes put in by key; a key whose new value is null goes."""
    return replace_by_key(old, changes, keys).where(F.col(value).isNotNull())
