"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_tree, jaccard, line_dedup, mixing, quality
from quire.llm.queries import BYTE_BPE, MIX_SEED, MIX_WEIGHTS, pattern, tokenizer
from quire.llm.shared import cut
from quire.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    ship(spark)
    return quality.kept(docs, "text", quality.fit(docs, "text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars, where there is one, follows the text, and no other column changes.

    Copies of a text count as one page: they are taken out later, and one of them has to keep its lines.
    """
    name = lambda c: "`" + c.replace("`", "``") + "`"
    others = [F.col(name(c)).alias(c) for c in docs.columns if c not in ("source", "text")]
    row = F.struct(*others) if others else F.lit(True)
    kept = line_dedup.drop_boilerplate(docs.select(row.alias("row"), "source", "text"), "source", "text")
    of = {c: F.col(c) if c in ("source", "text") else F.col("row")[c] for c in docs.columns}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(of["n_chars"])
    return kept.select(*[of[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest doc_id.

    Texts without words have no near copies and stay; so do documents without an id whose group has no id at all.
    """
    ship(spark)
    return jaccard.one_of_each(docs, "doc_id", "text", k=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to three times)."""
    mixed, _ = mixing.mix(docs, F.array("source"), "doc_id", mixing.words(F.col("text")), MIX_WEIGHTS, MIX_SEED)
    return mixed.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("__row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    ship(spark)
    return bpe_tree.encode_documents(docs, "text", ["doc_id", "lang", "source"], tokenizer(BYTE_BPE), pattern())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: The classifier's weights and the byte-pair encoding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
