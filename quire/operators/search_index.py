"""Literal search by postings of trigrams, so that a search reads files that can hold the query and not the corpus.

A built index is a folder of three tables.  ``rows`` are the segments in ranges of their order, a folder each; ``postings`` tell the rows that hold a trigram, in slots by
the trigram's hash; ``counts`` tell how many those are.  A search reads the slots of the query's rarest trigrams, and then only the ranges that have rows with all of them;
``contains`` decides about every row, so hits are those of a scan.  Trigrams are of characters with A-Z folded to a-z, as the search compares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import reading

#: Folders of postings; trigrams that a search looks up, the rarest of the query's.
SLOTS, RAREST = 256, 4
#: An id is the number of its range, and in the lowest bits a place in it.
PLACE_BITS = 33


def trigrams(text: Column) -> Column:
    """The different trigrams of a text; none of a null or a shorter one."""
    chars = F.split(X.fold(F.coalesce(text, F.lit(""))), "")
    each = X.let(chars, lambda c: F.transform(F.sequence(F.lit(3), F.size(c)), lambda i: F.concat(c[i - 3], c[i - 2], c[i - 1])))
    return F.when(F.length(text) >= 3, F.array_distinct(F.filter(each, lambda g: F.length(g) == 3))).otherwise(F.array().cast("array<string>"))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def build(rows: DataFrame, texts: list[str], order: list[str], path: str, parts: int | None = None) -> None:
    """Write the index of ``texts`` of rows, in ``parts`` ranges of ``order`` (as many as the session has shuffle partitions), to the folder ``path``."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).withColumn("row_id", F.monotonically_increasing_id())
    dealt.write.partitionBy("part").parquet(f"{path}/rows")
    held = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in texts])))
    found = stored(spark, path, "rows").select("row_id", F.explode(held).alias("gram")).withColumn("slot", _slot(F.col("gram")))
    found.repartitionByRange("slot", "gram", "row_id").sortWithinPartitions("slot", "gram", "row_id").write.partitionBy("slot").parquet(f"{path}/postings")
    stored(spark, path, "postings").groupBy("slot", "gram").agg(F.count("*").alias("n")).repartition("slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{path}/counts")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows that have all of the query's rarest trigrams; a query of fewer than three characters can be in any row."""
    rows = stored(spark, path, "rows")
    folded = query.strip().translate(str.maketrans(X.UPPER, X.LOWER))
    grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    if not grams:
        return rows
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _slot(F.col("gram")).alias("slot")).collect()
    of = lambda name, picked: stored(spark, path, name).where(F.col("slot").isin([s for _, s in picked]) & F.col("gram").isin([g for g, _ in picked]))
    # At most a row for each trigram of the query.
    counts = {r.gram: (r.n, r.slot) for r in of("counts", asked).collect()}
    if len(counts) < len(grams):
        return rows.where("false")
    rarest = sorted(counts, key=lambda g: (counts[g][0], g))[:RAREST]
    ids = of("postings", [(g, counts[g][1]) for g in rarest]).groupBy("row_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("row_id")
    # Numbers of ranges, of which there are as many as the index has parts.
    parts = [r.part for r in ids.select(F.shiftright("row_id", PLACE_BITS).cast("int").alias("part")).distinct().collect()]
    return rows.where(F.col("part").isin(parts)).join(ids, "row_id", "left_semi") if parts else rows.where("false")


def search(spark: SparkSession, path: str, query: str, keys: list[str], order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """``reading.search`` of the rows that the index was built of, which need original_text and translated_text."""
    return reading.search(candidates(spark, path, query), query, keys, order, limit, offset).drop("part", "row_id")
