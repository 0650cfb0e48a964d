"""Record files: checkpoints, key-value maps, exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """The last whole record of each id of append-only JSON lines; lines that do not parse, or have no id, are passed over.

    Order is that of the files' names and of the lines in them; a file is one writer's, so the lines of an id are read in order by one task.
    """
    bad = "__bad"
    rows = spark.read.schema(StructType([*schema.fields]).add(bad, "string")).option("columnNameOfCorruptRecord", bad).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    rows = rows.where(F.col(bad).isNull() & F.col(key).isNotNull())
    values = [f.name for f in schema.fields if f.name != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("__file", "__block", "__line")).alias("x"))
    return last.select(key, *[F.col(f"x.{v}").alias(v) for v in values]).select(*[f.name for f in schema.fields])


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file that is one JSON object of strings."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return rows.select(F.explode("m").alias("key", "value"))


def with_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, value of a map after the entries of ``new`` are set."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def write_key_values(rows: DataFrame, path: str) -> None:
    """A map as one JSON object in one file; small by nature."""
    rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")).select(F.to_json("m")).coalesce(1).write.mode("overwrite").text(path)


def export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of an export: files that hold one JSON array each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one JSON document a row; small by nature, so one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Put rows in the place of the partitions of their keys, and leave other partitions as they are; doing it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def schema_gaps(found: dict[str, list[str]], wanted: dict[str, list[str]]) -> list[str]:
    """What of the wanted tables and columns is missing, as ``table`` or ``table.column``."""
    return sorted([t for t in wanted if t not in found] + [f"{t}.{c}" for t in wanted if t in found for c in wanted[t] if c not in found[t]])
