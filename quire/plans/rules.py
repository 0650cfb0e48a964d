"""Rules that stand for themselves: existence, orders, changes of some columns, moves, status, references to notes, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import accounts, chapters, evaluation, jobs, mutation, ranks, shelf
from quire.plans.registry import query
from quire.sources.tables import table


@query("""
    WITH u AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'email:' || c_name ELSE 'g' || c_custkey // 2 END AS google_id FROM customer),
    i AS (SELECT 'google' AS provider, 'g' || s_suppkey AS provider_id, -s_suppkey AS user_id FROM supplier),
    n AS (SELECT 'google' AS provider, google_id AS provider_id, min(user_id) AS user_id FROM u WHERE google_id NOT LIKE 'email:%' GROUP BY google_id)
    SELECT * FROM i UNION ALL SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.provider = n.provider AND i.provider_id = n.provider_id)""")
def linked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities after those of users not born by e-mail are put in; of users with the same provider's id the first counts."""
    key = F.col("c_custkey")
    google = F.when(key % 4 == 0, None).when(key % 4 == 1, F.concat(F.lit("email:"), "c_name")).otherwise(F.concat(F.lit("g"), F.floor(key / 2).cast("string")))
    users = table(spark, sf_dir, "customer").select(key.alias("user_id"), google.alias("google_id"))
    first = users.groupBy("google_id").agg(F.min("user_id").alias("user_id"))
    links = table(spark, sf_dir, "supplier").select(F.lit("google").alias("provider"), F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("provider_id"), (-F.col("s_suppkey")).alias("user_id"))
    return accounts.linked_identities(first, links)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def has_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer has an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return mutation.with_existence(table(spark, sf_dir, "customer").select("c_custkey"), urgent, ["c_custkey"], "urgent")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_acctbal, c_custkey) - 1)::BIGINT AS place FROM customer")
def slots_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order of several keys, counted in ranges of it."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return ranks.numbered(rows, [], ["c_nationkey", "c_mktsegment", "c_acctbal", "c_custkey"]).select("c_custkey", F.col("at").cast("long").alias("place"))


@query("""
    WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS display_order, p_name AS title FROM part)
    SELECT id, (row_number() OVER (ORDER BY display_order NULLS FIRST, title, id) - 1)::BIGINT AS place FROM b""")
def books_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by their place by hand, those without one first, and then by title."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("display_order"), F.col("p_name").alias("title"))
    return ranks.numbered(rows, [], ["display_order", "title", "id"]).select("id", F.col("at").cast("long").alias("place"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS updated_at FROM orders""")
def set_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns set where a condition holds, one of them new."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    changed = mutation.set_columns(rows, F.col("o_orderstatus") == "F", {"o_orderpriority": F.lit("completed"), "o_totalprice": F.col("o_totalprice") / 2, "updated_at": F.col("o_orderdate")})
    return changed.select("o_orderkey", "o_orderpriority", "o_totalprice", "updated_at")


@query("""
    WITH p AS (SELECT c_custkey AS book_id, c_nationkey AS slot_id, (c_custkey * 7) % 1000 AS position FROM customer),
    m AS (SELECT min(c_custkey) AS book_id, (c_nationkey + 1) % 27 AS slot_id, (c_nationkey * 5) % 17 - 1 AS insert_index FROM customer GROUP BY c_nationkey),
    o AS (SELECT * FROM p WHERE book_id NOT IN (SELECT book_id FROM m)),
    r AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY position, book_id) - 1 AS at_ FROM o),
    l AS (
        SELECT m.book_id, m.slot_id, coalesce((SELECT position FROM r WHERE r.slot_id = m.slot_id AND r.at_ = greatest(0, m.insert_index)), (SELECT max(position) + 1 FROM r WHERE r.slot_id = m.slot_id), 0) AS position
        FROM m)
    SELECT o.book_id, o.slot_id, (o.position + CASE WHEN o.position >= l.position THEN 1 ELSE 0 END)::BIGINT AS position FROM o LEFT JOIN l USING (slot_id)
    UNION ALL SELECT book_id, slot_id, position::BIGINT FROM l""")
def moved_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book of each nation moves into the next nation's slot; its siblings from there on move right."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("slot_id"), (F.col("c_custkey") * 7 % 1000).alias("position"))
    nation = F.col("slot_id")
    moves = rows.groupBy("slot_id").agg(F.min("book_id").alias("book_id")).select("book_id", ((nation + 1) % 27).alias("slot_id"), (nation * 5 % 17 - 1).alias("insert_index"))
    return shelf.moved(rows, moves)


@query("""
    WITH b AS (SELECT c_custkey AS uuid, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 END AS user_id, CASE c_custkey % 2 WHEN 0 THEN 'processing' ELSE 'ready' END AS status FROM customer),
    j AS (SELECT o_custkey AS book_uuid, o_orderkey AS id, o_orderstatus AS status, o_orderkey % 7 AS completed_chapters, 7 AS total_chapters, o_orderkey % 3 AS current_chapter FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    a AS (SELECT event_id, event_id % 2000 AS uuid, CASE WHEN event_id % 4 > 0 THEN user_id % 5 END AS reader FROM events),
    s AS (SELECT a.*, b.status, b.uuid IS NOT NULL AND (b.user_id IS NULL OR coalesce(b.user_id = a.reader, FALSE)) AS seen, j.status AS phase, completed_chapters, total_chapters, current_chapter FROM a LEFT JOIN b USING (uuid) LEFT JOIN j ON j.book_uuid = a.uuid)
    SELECT event_id, uuid, reader, CASE WHEN seen THEN 200 ELSE 404 END AS answer, CASE WHEN seen THEN status END AS status, CASE WHEN seen AND status = 'processing' THEN phase END AS phase,
           CASE WHEN seen AND status = 'processing' THEN completed_chapters END AS completed, CASE WHEN seen AND status = 'processing' THEN total_chapters END AS total, CASE WHEN seen AND status = 'processing' THEN current_chapter END AS current FROM s""")
def book_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told of a book: not there, its status, and how far its first job is."""
    key = F.col("c_custkey")
    books = table(spark, sf_dir, "customer").select(key.alias("uuid"), F.when(key % 3 > 0, key % 5).alias("user_id"), F.when(key % 2 == 0, "processing").otherwise("ready").alias("status"))
    own = F.col("o_orderkey")
    work = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_uuid"), own.alias("id"), F.col("o_orderstatus").alias("status"), (own % 7).alias("completed_chapters"), F.lit(7).alias("total_chapters"), (own % 3).alias("current_chapter"))
    event = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", (event % 2000).alias("uuid"), F.when(event % 4 > 0, F.col("user_id") % 5).alias("reader"))
    return jobs.book_status(asked, books, work)


@query(r"""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS i FROM pages),
    l AS (
        SELECT page_id % 50 AS book, 'text/p' || page_id || '.html' AS file, CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'n' || page_id % 7 || '.html' WHEN 2 THEN 'notes/n' || i || '.html' ELSE 'other.html' END || CASE WHEN i % 3 > 0 THEN '#' || regexp_extract(a, '>([^<]*)<', 1) ELSE '' END AS href,
               CASE WHEN i % 5 > 0 THEN '[' || page_id || ']' ELSE regexp_extract(a, '>([^<]*)<', 1) END AS label, CASE WHEN i % 2 = 0 THEN 'r' || i END AS id, CASE WHEN page_id % 3 = 0 THEN 'q' END AS parent_id FROM a),
    n AS (SELECT DISTINCT page_id % 50 AS book, 'text/notes/n' || page_id % 7 || '.html' AS file FROM pages WHERE page_id % 50 < 30),
    k AS (SELECT book, list(file) AS known FROM n GROUP BY book),
    t AS (SELECT l.*, known, regexp_extract(href, '^([^#]*)', 1) AS path, regexp_extract(href, '#([^#]*)', 1) AS target_anchor FROM l JOIN k USING (book) WHERE href <> '')
    SELECT book, file, coalesce(id, parent_id) AS source_anchor, CASE WHEN path = '' THEN file ELSE path END AS target_file, target_anchor, regexp_extract(label, '(\d+)', 1) AS number
    FROM t WHERE regexp_matches(label, '\d') AND len(list_filter(known, lambda f: f = CASE WHEN path = '' THEN file ELSE path END OR ends_with(f, path) OR ends_with(path, regexp_extract(f, '([^/]*)$', 1)))) > 0""")
def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages, led to pages of notes here and there, that are references to notes."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("i", "a")
    page, i, told = F.col("page_id"), F.col("i"), F.regexp_extract("a", ">([^<]*)<", 1)
    text = lambda c: c.cast("string")
    path = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit("n"), text(page % 7), F.lit(".html"))).when(i % 4 == 2, F.concat(F.lit("notes/n"), text(i), F.lit(".html"))).otherwise("other.html")
    rows = table(spark, sf_dir, "pages").select("page_id", found).select(
        (page % 50).alias("book"), F.concat(F.lit("text/p"), text(page), F.lit(".html")).alias("file"), F.concat(path, F.when(i % 3 > 0, F.concat(F.lit("#"), told)).otherwise("")).alias("href"),
        F.when(i % 5 > 0, F.concat(F.lit("["), text(page), F.lit("]"))).otherwise(told).alias("label"), F.when(i % 2 == 0, F.concat(F.lit("r"), text(i))).alias("id"), F.when(page % 3 == 0, "q").alias("parent_id"),
    )
    notes = table(spark, sf_dir, "pages").where("page_id % 50 < 30").select((page % 50).alias("book"), F.concat(F.lit("text/notes/n"), text(page % 7), F.lit(".html")).alias("file"))
    return chapters.note_refs(rows, notes)


@query("""
    WITH s AS (SELECT p_brand AS model, p_type AS task, CASE WHEN p_partkey % 11 > 0 THEN p_size % 5 + 1 END AS score FROM part),
    m AS (SELECT task, model, avg(score) AS overall, count(*) AS judged FROM s GROUP BY task, model)
    SELECT task, model, judged, row_number() OVER (PARTITION BY task ORDER BY overall DESC NULLS LAST, model)::INTEGER AS place FROM m""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by their judges' mean score for each task, best first; those without a score last."""
    scores = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("task"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_size") % 5 + 1).alias("score"))
    means = scores.groupBy("task", "model").agg(F.avg("score").alias("overall"), F.count("*").alias("judged"))
    return evaluation.ranking(means, ["task"], [F.desc_nulls_last("overall"), F.col("model")]).select("task", "model", "judged", "place")
