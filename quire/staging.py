"""Written tables between steps of one operator: in the folder that all executors share, so that later steps start from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.  Only a local master may leave the setting unset, as tests do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"


def staged(rows: DataFrame) -> DataFrame:
    """rows, written as Parquet and read again."""
    path = folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing this folder."""
    system, own = file_system(spark, f"{path}/_SUCCESS")
    return bool(system.exists(own))
