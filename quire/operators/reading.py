"""Reading: search with snippets, chapters, positions and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.functions.numbers import cloud_millis, weighted_percent
from quire.operators.ranks import carried

NODE = T.ArrayType(
    T.StructType([T.StructField("xpath", T.StringType()), T.StructField("text", T.StringType()), T.StructField("html", T.StringType()), T.StructField("orderIndex", T.IntegerType())])
)


def node_rows(chapters: DataFrame, nodes_json: str) -> DataFrame:
    """Chapters times their text nodes; chapters without any have no row."""
    return chapters.withColumn("node", F.explode(F.from_json(nodes_json, NODE))).select(*[c for c in chapters.columns if c != nodes_json], "node.xpath", "node.text", F.col("node.orderIndex").alias("order_index"))


def segments(chapters: DataFrame, translations: DataFrame) -> DataFrame:
    """One relation to search: translated paragraphs, and the text nodes of books that have no translation at all.

    Which of the two a book has is told by an anti join, for all books at once.
    """
    of = chapters.select("book_id", F.col("id").alias("chapter_id"), "chapter_number", "chapter_title", F.col("order_index").alias("chapter_order"))
    done = of.join(translations, "chapter_id")
    nodes = node_rows(chapters.select("book_id", "chapter_number", "chapter_title", F.col("order_index").alias("chapter_order"), "text_nodes_json"), "text_nodes_json")
    plain = nodes.join(done.select("book_id").distinct(), "book_id", "left_anti").select("book_id", "chapter_number", "chapter_title", "chapter_order", "xpath", F.col("text").alias("original_text"), F.lit(None).cast("string").alias("translated_text"), "order_index")
    return done.select(*plain.columns).unionByName(plain)


def search(rows: DataFrame, query: str, keys: list[str], order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """Hits of a literal query in original_text or translated_text, as one page for each of ``keys``.

    Hits are ranked by ``order``, which must end in a unique key; a page holds ``limit`` of them from ``offset`` on, with ``snippet``, ``field`` and
    ``has_more``.  An empty query has no hits.
    """
    q = F.lit(query.strip())
    original, translated = X.snippet(F.col("original_text"), q), X.snippet(F.col("translated_text"), q)
    hit = X.holds(F.col("original_text"), q) | X.holds(F.col("translated_text"), q)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.where((q != "") & F.coalesce(hit, F.lit(False))).withColumn("rank", rank).where(F.col("rank") <= offset + limit + 1)
    more = F.max("rank").over(Window.partitionBy(*keys)) > offset + limit
    field = F.when(F.coalesce(X.holds(F.col("original_text"), q), F.lit(False)), "original").otherwise("translated")
    page = ranked.withColumn("has_more", more).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return page.withColumn("snippet", F.coalesce(original, translated)).withColumn("field", field)


def chapter_lengths(chapters: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chapters with ``text_length``, 0 where they have no text."""
    lengths = texts.groupBy(F.col(key).alias("length_of")).agg(F.sum(F.length(text)).cast("long").alias("n"))
    return chapters.join(lengths, F.col(key) == F.col("length_of"), "left").select(*chapters.columns, F.coalesce("n", F.lit(0).cast("long")).alias("text_length"))


def nearest_chapter(asked: DataFrame, chapters: DataFrame, key: str, number: str, wanted: str) -> DataFrame:
    """asked with ``actual``: the chapter itself, else the largest below it, else the smallest; null for books without chapters.

    Requests and chapters are put in one order, chapters first at the same place, and each request carries the last chapter before it; a request below all chapters
    takes the book's first, by one aggregate.  No request ever meets a book's chapters, and a book of many requests is cut into ranges.
    """
    request = F.struct(*[F.col(c) for c in asked.columns])
    places = chapters.select(F.col(key).alias("__key"), F.col(number).alias("__place"), F.lit(0).alias("__kind"), F.lit(None).cast(asked.select(request.alias("r")).schema[0].dataType).alias("__asked")).where(F.col("__place").isNotNull() & F.col("__key").isNotNull())
    rows = places.unionByName(asked.select(F.col(key).alias("__key"), F.col(wanted).alias("__place"), F.lit(1).alias("__kind"), request.alias("__asked")))
    found = carried(rows, ["__key"], ["__place", "__kind"], F.when(F.col("__kind") == 0, F.col("__place")), "__below").where("__kind = 1")
    first = places.groupBy(F.col("__key").alias("__of")).agg(F.min("__place").alias("__first"))
    return found.join(first, F.col("__key") == F.col("__of"), "left").select("__asked.*", F.coalesce("__below", "__first").alias("actual"))


def shown_text(nodes: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with ``shown``: the translation of their xpath, or the source text where there is none or it is empty."""
    done = translations.select(*[F.col(k).alias(f"t_{k}") for k in keys], "translated_text")
    match = [F.col(k) == F.col(f"t_{k}") for k in keys]
    return nodes.join(done, match, "left").select(*nodes.columns, F.coalesce(F.nullif("translated_text", F.lit("")), "text").alias("shown"))


def html_of(rows: DataFrame, keys: list[str], xpath: str, order: list[str], html: Column) -> DataFrame:
    """``raw_html`` of each key: its paragraphs in order, each in the element that its xpath ends in, without internal links."""
    tag = F.regexp_extract(xpath, r"(?i)/([a-z0-9]+)\[\d+\]$", 1)
    plain = F.regexp_replace(html, r"(?is)<a\s+[^>]*href\s*=\s*[\"'](?!https?://)[^\"']*[\"'][^>]*>(.*?)</a>", "$1")
    plain = F.regexp_replace(plain, r"(?i)<a\s+[^>]*/>", "")
    name = F.when(tag != "", tag).otherwise("p")
    one = F.concat(F.lit("<"), name, F.lit(' data-xpath="'), F.col(xpath), F.lit('">'), plain, F.lit("</"), name, F.lit(">"))
    parts = rows.select(*keys, F.struct(*order, one.alias("one")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select(*keys, F.array_join(F.transform("x", lambda x: x["one"]), "\n").alias("raw_html"))


def progress_percent(chapters: DataFrame, keys: list[str], order: str, length: str, fraction: Column) -> DataFrame:
    """Chapters with ``percent``: the progress of a reader who is at ``fraction`` of each of them."""
    per = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(length).over(per.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = F.row_number().over(per.orderBy(order)) - 1
    return chapters.withColumn("percent", weighted_percent(before, F.coalesce(length, F.lit(0)), F.sum(length).over(per), index, F.count("*").over(per), fraction))


def chapter_fraction(chapters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Place of a chapter between 0 and 1; 0 if it is the only one."""
    return chapters.withColumn("chapter_fraction", F.percent_rank().over(Window.partitionBy(*keys).orderBy(order)))


def merge_progress(local: DataFrame, cloud: DataFrame, key: str) -> DataFrame:
    """The newer of a local (chapter, xpath, show_original, ts_ms) and a cloud record (chapter_number, paragraph_xpath, show_original, updated_at).

    A tie, or a cloud record without a chapter or a time, leaves the local one.
    """
    other = cloud.select(F.col(key).alias("cloud_key"), "chapter_number", F.nullif("paragraph_xpath", F.lit("")).alias("cloud_xpath"), (F.col("show_original") == 1).alias("cloud_show"), cloud_millis(F.col("updated_at")).alias("cloud_ms"))
    rows = local.join(other, F.col(key) == F.col("cloud_key"), "left")
    newer = (F.coalesce("chapter_number", F.lit(0)) != 0) & (F.col("cloud_ms") > F.col("ts_ms"))
    pick = lambda cloud_side, own: F.when(newer, F.col(cloud_side)).otherwise(F.col(own))
    return rows.select(key, pick("chapter_number", "chapter").alias("chapter"), pick("cloud_xpath", "xpath").alias("xpath"), pick("cloud_show", "show_original").alias("show_original"),
        pick("cloud_ms", "ts_ms").alias("ts_ms"), F.when(newer, "cloud").otherwise("local").alias("source"))


def most_recent(progress: DataFrame, books: DataFrame, user: str) -> DataFrame:
    """For each user the book read last (ties to the smaller uuid); books that are processing or unknown do not count."""
    rows = progress.join(books.where(F.col("status") != "processing").select("uuid"), "uuid").where(F.col("last_read_at").isNotNull())
    first = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last_read_at"), "uuid"))
    return rows.withColumn("n", first).where("n = 1").select(user, "uuid", "last_read_at")


def local_saves(saves: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Saves (chapter, xpath, ts_ms) as the device keeps them: an xpath outlives a save without one only inside the same chapter; without a time it is 0."""
    before = Window.partitionBy(user).orderBy(*order)
    group = F.sum(F.when(F.col("chapter").eqNullSafe(F.lag("chapter").over(before)), 0).otherwise(1)).over(before)
    kept = F.last("xpath", ignorenulls=True).over(Window.partitionBy(user, "run").orderBy(*order))
    return saves.withColumn("run", group).withColumn("xpath", kept).withColumn("ts_ms", F.coalesce("ts_ms", F.lit(0))).drop("run")


def last_places(visits: DataFrame, key: str, order: list[str], place: str, most: int) -> DataFrame:
    """key, ``places``: the last ``most`` places of each key, the latest last."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    last = visits.withColumn("k", at).where(F.col("k") <= most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col(place).alias("place"))))
    return last.groupBy(key).agg(F.transform(ordered, lambda x: x["place"]).alias("places"))
