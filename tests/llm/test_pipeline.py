import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard, line_dedup
from quire.llm.shared import cut

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, FOLDER))
        kept.append((before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    classified = ids(kept[0][1])
    unfit = [d for d, q in labels.items() if not q]
    assert all(d in classified for d, q in labels.items() if q) and sum(d in classified for d in unfit) < len(unfit) / 2
    assert ids(kept[1][1]) == classified
    found = jaccard.classes(kept[2][0], "doc_id", "text", 5, 80, 100).collect()
    assert ids(kept[2][1]) == {r.component_id for r in found} and kept[2][1].count() == len({r.component_id for r in found})
    bad = {(r.host, key) for r in line_dedup.boilerplate(kept[1][0], F.col("source"), F.col("text")).collect() for key in r.lines}
    lines = F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))))
    share = lambda df: {(r.source, r.key) for r in df.select("source", lines.alias("key")).distinct().collect()}
    assert bad <= share(kept[1][0]) and not bad & share(kept[1][1]) and share(kept[1][0]) - bad == share(kept[1][1])
    times = kept[3][1].groupBy("doc_id").count().collect()
    assert times and max(r["count"] for r in times) <= 3
    assert kept[4][1].count() == kept[4][0].count()
    texts = {r.doc_id: r.text for r in kept[4][0].collect()}
    assert all(r.text == texts[r.doc_id] for r in kept[4][1].collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_repeated_rows_are_copies(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 2 + [(None, "x y z x y z q", "en", "s", 13), (2, "A b c d e f g", "en", "s", 13), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, 4, None]


def test_copies_keep_their_lines(spark):
    copy = "first line of the copy\nsecond line of the copy"
    texts = [copy] * 20 + [f"page {i}\nMenu" for i in range(38)] + [None, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, FOLDER).collect()}
    assert len(got) == 60 and all(got[i] == (copy, len(copy)) for i in range(20))
    assert all(got[20 + i] == (f"page {i}", len(f"page {i}")) for i in range(38)) and got[58][0] is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_rows(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER).count() == 0


def test_line_dedup_leaves_other_columns_alone(spark):
    """Columns with the operator's own names or odd ones, and a table without n_chars."""
    rows = [(i, f"page {i}\nMenu", "s", 7, 8, "a", "b") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_dropped int, `x.y` string, row string")
    got = corpus_pipeline.lines(spark, docs, FOLDER)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(i, f"page {i}", "s", 7, 8, "a", "b") for i in range(6)]
    counted = corpus_pipeline.lines(spark, docs.select("doc_id", "text", "source", F.lit(11).cast("long").alias("n_chars")), FOLDER)
    assert {r.n_chars for r in counted.collect()} == {6}
