"""What the operators of this subpackage share: lineage cuts and whole-table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the contracts name it: ``[\x20\x09-\x0D]``; ``bytes.split`` splits on exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Only a local master may leave the setting unset (tests do); it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages start from files, not from lineage."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a side that is broadcast at most; a larger side is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to have no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``position``, from 0, in ``order``: rows are numbered inside sorted ranges, and each range starts where those before it end."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    start, starts = 0, []
    for r in sorted(ranged.groupBy("range").count().collect()):
        starts.append((r[0], start))
        start += r[1]
    told = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, start long"))
    position = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("start")
    return ranged.join(told, "range").withColumn("position", position.cast("long")).drop("range", "start")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
