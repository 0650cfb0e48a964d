"""Quality of translations: corpus scans, model metrics, judges and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.operators.jobs import FAILED_MARK
from quire.operators.terms import found_terms
from quire.staging import staged


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole, ``empty`` where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def flag_sums(flagged: Column, eligible: Column) -> list[Column]:
    """``total``, ``eligible`` and ``flagged`` among the eligible, as aggregates."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return [F.count("*").alias("total"), n(eligible).alias("eligible"), n(flagged & eligible).alias("flagged")]


def shares(sums: DataFrame) -> DataFrame:
    return sums.select("*", ratio(F.col("flagged"), F.col("total")).alias("share_of_all"), ratio(F.col("flagged"), F.col("eligible")).alias("share_of_eligible"))


def flag_rates(rows: DataFrame, flagged: Column, eligible: Column) -> DataFrame:
    """Flagged rows, and their share of all and of the eligible ones."""
    return shares(rows.agg(*flag_sums(flagged, eligible)))


def top_words(rows: DataFrame, words: str, n: int = 25) -> DataFrame:
    """The most frequent words of an array column; ties in the order of code points."""
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def corpus_scan(segments: DataFrame, chapters: DataFrame, books: DataFrame, words: Column, mostly: Column, samples: int = 45) -> dict[str, DataFrame]:
    """Residue of a whole corpus: rates, frequent words, some samples and the ids of flagged segments, of books translated to Chinese.

    The corpus is read and its residue worked out once: the rates are counted as the flagged segments, which are few, are written, and all else is read from those.
    """
    rows = segments.join(chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id").join(books.where(F.col("language_pair").endswith("-zh")).select(F.col("id").alias("book_id")), "book_id")
    rows = rows.withColumn("mostly", F.coalesce(mostly, F.lit(False))).withColumn("words", words)
    seen = Observation()
    flagged = staged(rows.observe(seen, *flag_sums(F.size("words") > 0, F.col("mostly"))).where(F.col("mostly") & (F.size("words") > 0)))
    counts = segments.sparkSession.createDataFrame([tuple(seen.get[c] for c in ("total", "eligible", "flagged"))], "total long, eligible long, flagged long")
    return {"rates": shares(counts), "words": top_words(flagged, "words"), "samples": flagged.orderBy("segment_id").limit(samples), "ids": flagged.select("segment_id")}


def term_checks(rows: DataFrame, glossary: DataFrame, source: str, target: str) -> DataFrame:
    """One row for each term that is in a row's source, with ``kept``: whether its translation is in the target.

    Terms and translations are found by an index over them, so no row meets terms that it does not hold (``operators/terms.py``).
    """
    return found_terms(rows, source, glossary, "term", target, "translation")


def metrics(rows: DataFrame, keys: list[str], residue: Column, checks: Column, kept: Column) -> DataFrame:
    """For each model: share of segments translated, share of those with residue, share of terms kept (null without any), share parsed (1 without any)."""
    done = F.col("translated_text").isNotNull() & (F.col("translated_text") != "") & (F.col("translated_text") != FAILED_MARK)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        ratio(n(done), F.count("*"), 0.0).alias("completeness"), ratio(n(done & (F.size(residue) > 0)), n(done), 0.0).alias("residue_rate"),
        ratio(F.sum(kept), F.sum(checks)).alias("adherence"), ratio(n(F.col("parsed")), F.sum(F.when(F.col("parsed").isNotNull(), 1).otherwise(0)), 1.0).alias("parse_rate"),
    )


def judge_means(scores: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """Mean of each dimension, missing ones as 0, and the mean of the means."""
    means = scores.groupBy(*keys).agg(*[F.avg(F.coalesce(d, F.lit(0))).alias(d) for d in dimensions])
    total = F.lit(0.0)
    for d in dimensions:
        total = total + F.col(d)
    return means.withColumn("overall", total / len(dimensions))


def ab_tally(votes: DataFrame, tag: str) -> DataFrame:
    """Wins of a, b and ties, for each tag and for all (tag null); an answer that names neither is a tie."""
    winner = F.when(F.lower(F.trim("winner")).isin("a", "b"), F.lower(F.trim("winner"))).otherwise("tie")
    n = lambda w: F.sum(F.when(winner == w, 1).otherwise(0)).cast("long").alias(f"wins_{w}")
    return votes.rollup(tag).agg(n("a"), n("b"), n("tie"))


def variant_groups(glossary: DataFrame, honorifics: str) -> DataFrame:
    """Translations that more than one term has, after honorifics are taken off, with their terms in order."""
    plain = F.trim(F.regexp_replace("translation", honorifics, ""))
    groups = glossary.withColumn("plain", plain).groupBy("plain").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return groups.where(F.size("terms") > 1)


def merged_glossary(layers: list[DataFrame]) -> DataFrame:
    """One glossary of several: of a term in more than one, the last layer's entry counts."""
    rows = None
    for n, layer in enumerate(layers):
        ranked = layer.select("term", "translation", F.lit(n).alias("layer"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    return rows.groupBy("term").agg(F.max_by("translation", "layer").alias("translation"))


def canonical(text: Column, variants: dict[str, str]) -> Column:
    """Variants in a text become their canonical form, longer ones first."""
    for variant in sorted(variants, key=lambda v: (-len(v), v)):
        text = F.replace(text, F.lit(variant), F.lit(variants[variant]))
    return text


def fix_count(before: Column, after: Column) -> Column:
    return F.sum(F.when(~before.eqNullSafe(after), 1).otherwise(0)).cast("long")


def ranking(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
