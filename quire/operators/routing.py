"""Texts through an answering service: batches, answers, routes, retries and marks.

The rows that still want an answer are a frontier.  Each attempt puts the frontier in batches anew, asks once for each batch, takes the answers that hold, and leaves
the rest as the next frontier; the last attempt asks for each row alone and marks what has no answer then.  So there are as many rounds as attempts and no more.
An attempt is written as a table of its own before the next starts, and a run that finds it whole does not ask again: after a lost driver the same call goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.residue import keeps_retry
from quire.operators.folds import batches
from quire.operators.jobs import FAILED_MARK
from quire.staging import is_whole

#: What a batch of several texts is asked with, and a text alone (the second argument: 1, or 2 when the first answer had untranslated words).  Null: the call failed.
Batch = Callable[[Column], Column]
Alone = Callable[[Column, int], Column]


def request(parts: Column) -> Column:
    """The text that a batch is asked with, of an array of (at, text)."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit('<seg id="'), p["at"].cast("string"), F.lit('">'), p["text"], F.lit("</seg>"))), "\n")


def asked_alone(text: Column, alone: Alone, residue: Callable[[Column], Column]) -> Column:
    """The answer to one text: with untranslated words it is asked again, and the second answer counts if it has fewer; null if a call fails."""
    first, second = X.trimmed(alone(text, 1)), X.trimmed(alone(text, 2))
    again = F.when(second.isNotNull(), F.when(keeps_retry(residue(first), residue(second)), second).otherwise(first))
    return F.when(first.isNotNull(), F.when(F.size(residue(first)) == 0, first).otherwise(again))


def attempted(frontier: DataFrame, keys: list[str], order: list[str], text: str, budget: int, batch: Batch, alone: Alone, residue: Callable[[Column], Column], hot_rows: int | None = None) -> DataFrame:
    """frontier with ``translated`` (null where it failed) and ``route``: blank, single or batch.

    A batch's rows are of one key, in ``order``, of ``budget`` tokens at most, or one larger row.  An answer holds if it has the row's segment and no untranslated word.
    Blank texts are their own translation and are not asked for, so every row of a batch counts, and a batch never has more rows than tokens.
    """
    own = frontier.columns
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s", " ")), F.lit("")) == ""
    done = frontier.where(blank).select(*own, F.lit("").alias("translated"), F.lit("blank").alias("route"))
    sized = frontier.where(~blank).withColumn("__size", X.batch_tokens(F.col(text)))
    dealt = batches(sized, keys, order, "__size", budget, hot_rows).withColumnRenamed("batch", "__batch")
    at = F.row_number().over(Window.partitionBy(*keys, "__batch").orderBy(*order))
    grouped = dealt.withColumn("__at", at).groupBy(*keys, "__batch").agg(F.array_sort(F.collect_list(F.struct("__at", F.struct(*own).alias("row")))).alias("rows"))
    sent = request(F.transform("rows", lambda r: F.struct(r["__at"].alias("at"), r["row"][text].alias("text"))))
    answered = grouped.withColumn("several", F.size("rows") > 1).withColumn("answer", F.when(F.col("several"), X.segments(batch(sent))))
    rows = answered.select("several", "answer", F.explode("rows").alias("r")).select("several", F.element_at("answer", F.col("r.__at")).alias("answer"), "r.row.*")
    taken = F.when(~F.col("several"), asked_alone(F.col(text), alone, residue)).when(F.size(residue(F.col("answer"))) == 0, F.col("answer"))
    return done.unionByName(rows.select(*own, taken.alias("translated"), F.when(F.col("several"), "batch").otherwise("single").alias("route")))


def translated(nodes: DataFrame, keys: list[str], order: list[str], text: str, budgets: list[int], batch: Batch, alone: Alone, residue: Callable[[Column], Column], path: str, hot_rows: int | None = None) -> DataFrame:
    """nodes with ``translated``, ``route`` (blank, batch, single, retry or marker) and ``attempt`` (from 1): one attempt in batches for each of ``budgets``, and one alone.

    ``path`` is a folder of this run's own, for an attempt each; attempts that are whole there are not made again.  A row whose last call fails too gets FAILED_MARK.
    ``keys`` and ``order`` together must tell rows apart.
    """
    spark, frontier, found = nodes.sparkSession, nodes, []
    for n, budget in enumerate([*budgets, None], 1):
        place = f"{path}/attempt={n}"
        if not is_whole(spark, place):
            if budget is None:
                answer = asked_alone(F.col(text), alone, residue)
                made = frontier.select("*", F.coalesce(answer, F.lit(FAILED_MARK)).alias("translated"), F.when(answer.isNull(), "marker").otherwise("retry").alias("route"))
            else:
                made = attempted(frontier, keys, order, text, budget, batch, alone, residue, hot_rows)
            made.withColumn("attempt", F.lit(n)).write.mode("overwrite").parquet(place)
        made = spark.read.parquet(place)
        found.append(made.where(F.col("translated").isNotNull()))
        frontier = made.where(F.col("translated").isNull()).select(*nodes.columns)
        if frontier.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
