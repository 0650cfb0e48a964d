"""SQL scripts as rows: statements that put tables elsewhere, and scripts split into statements; keys of stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value: Column, kind: T.DataType) -> Column:
    """A value as SQL has it: numbers as they are, anything else in single quotes, which are doubled inside; NULL for null."""
    text = value.cast("string")
    return F.coalesce(text if isinstance(kind, T.NumericType) else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def replacing(rows: DataFrame, table: str, key: str) -> DataFrame:
    """rows with ``statements``: for each row, one that deletes what has its key and one that inserts it.  Running them again changes nothing."""
    of = lambda c: literal(F.col(c), rows.schema[c].dataType)
    gone = F.concat(F.lit(f"DELETE FROM {table} WHERE {key} = "), of(key), F.lit(";"))
    put = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), F.concat_ws(", ", *map(of, rows.columns)), F.lit(");"))
    return rows.withColumn("statements", F.array(gone, put))


def split(script: Column) -> Column:
    """The statements of a script: lines that are comments go, semicolons divide, blank statements are none."""
    plain = F.regexp_replace(script, r"(?m)^\s*--.*$", "")
    return F.filter(F.transform(F.split(plain, ";"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def inside_store(key: Column) -> Column:
    """Whether an object's key stays inside its store: not empty, not absolute, and with no step above the top."""
    step = lambda p: F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
    depth = F.aggregate(
        F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["now"] + step(p)).alias("now"), F.least(a["least"], a["now"] + step(p)).alias("least")),
    )
    return F.coalesce((key != "") & ~key.rlike(r"^[/\\]") & (depth["least"] >= 0) & (depth["now"] > 0), F.lit(False))


def objects(files: DataFrame, metas: DataFrame) -> DataFrame:
    """key, content, content_type of stored objects (key, content) with their side files (key, meta as JSON); keys that leave the store, and side files themselves, are no objects."""
    told = metas.select(F.col("key").alias("of"), F.from_json("meta", "content_type string").alias("m"))
    own = files.where(inside_store(F.col("key")) & ~F.col("key").endswith(".meta.json"))
    return own.join(told, F.col("key") == F.col("of"), "left").select("key", "content", F.col("m.content_type").alias("content_type"))
