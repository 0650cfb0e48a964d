"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, line (from 0), text: the lines of each document that are not blank; the number counts blank ones too."""
    rows = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.where(F.trim("text") != "")
