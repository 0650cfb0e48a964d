"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host.  For each host and line, the share of the host's different pages that contain the line is computed, and
lines whose share exceeds the boilerplate ratio are dropped from the host's pages.  Pages of a host with equal texts are one page:
a group of copies says nothing about which lines are boilerplate, and would otherwise lose its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut

#: A line is boilerplate on a host if more than this share of the host's pages contain it.
RATIO = 0.05
#: Lines on fewer pages of a host than these are never boilerplate.
LEAST_WITH_LINE = 3
#: Boilerplate lines of all hosts together that are broadcast; with more, hosts are joined over SALTS parts each.
BROADCAST_LINES = 500_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """What makes two lines the same: the line without outer spaces, as a 64-bit hash."""
    return F.xxhash64(F.trim(line))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_with_line: int = LEAST_WITH_LINE) -> DataFrame:
    """host, lines array<bigint>: the keys of each host's boilerplate lines, for hosts that have any.

    Rows of a host with the same text are one page (by a 64-bit hash; null texts are one too), and a page counts once for each different line: a shuffle of
    (host, text hash, key) drops what repeats, and counts go by (host, key) after map-side sums.  A host has at most (its lines a page) / ratio such lines,
    whatever the number of its pages.
    """
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: ~_blank(x)), _key))
    marked = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(keys, F.array().cast("array<bigint>")))
    rows = pages.select(host.alias("host"), F.xxhash64(text).alias("copy"), F.explode(marked).alias("key")).distinct()
    counts = cut(rows.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("key").isNull() | (F.col("n") >= least_with_line)))
    totals = counts.where(F.col("key").isNull()).select(F.col("host").alias("of"), F.col("n").alias("pages"))
    lines = counts.where(F.col("key").isNotNull())
    lines = lines.join(totals, lines["host"].eqNullSafe(totals["of"])).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return lines.groupBy("host").agg(F.collect_list("key").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_with_line: int = LEAST_WITH_LINE) -> DataFrame:
    """The rows of ``pages`` with ``text`` less its boilerplate lines; ``n_lines`` and ``n_dropped`` follow, in place of columns of these names.

    Null texts stay null and have 0 lines; blank lines are never dropped; a null host is a host; repeated rows are one page and stay; all other columns stay, whatever
    their names.  An empty table gives an empty table.
    """
    name = lambda c: "`" + c.replace("`", "``") + "`"
    own = pages.select(F.struct(*[F.col(name(c)) for c in pages.columns]).alias("row"), F.col(name(host)).alias("host"), F.col(name(text)).alias("text"))
    bad = cut(boilerplate(own, F.col("host"), F.col("text"), ratio, least_with_line)).select(F.col("host").alias("of"), F.col("lines").alias("bad"))
    if bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()[0] <= BROADCAST_LINES:
        joined = own.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("of")), "left")
    else:
        salted = own.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(bad, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")), "left")
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("bad"), _key(x)))
    out = joined.select("row", "text", F.col("bad").isNull().alias("clean"), F.coalesce(F.size(lines), F.lit(0)).alias("n"), F.when(F.col("bad").isNull(), lines).otherwise(kept).alias("kept"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long")
    stay = [F.when(F.col("clean"), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*stay, count.alias("n_lines"), (count - F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))).cast("long").alias("n_dropped"))
