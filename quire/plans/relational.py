"""Listings, search, joins, aggregates and completeness over the driver's tables.

The tables stand in for a library's: customers for books, nations for slots, orders and lines for chapters and their rows, documents and conversations for
chapters with text, events for whatever users do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers, text
from quire.operators import evaluation, jobs, ledger, limits, mutation, reading, sampling, shelf
from quire.plans.registry import query
from quire.sources.tables import lines, table

USER = 7
LINES_SQL = """lines AS (
    SELECT doc_id, lang, source, (u.i - 1)::INTEGER AS line, string_split(text, chr(10))[u.i] AS text
    FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE trim(string_split(text, chr(10))[u.i]) <> '')"""


@query(f"""
    WITH {LINES_SQL},
    hit AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line)::INTEGER AS rank, instr(lower(text), 'the') AS pos FROM lines
        WHERE contains(translate(text, '{text.UPPER}', '{text.LOWER}'), 'the')),
    cut AS (SELECT *, greatest(1, pos - 40) AS a, least(length(text), pos - 1 + 3 + 40) AS b, max(rank) OVER (PARTITION BY lang) > 50 AS has_more FROM hit)
    SELECT lang, doc_id, line, rank, has_more, 'original' AS field,
           CASE WHEN pos > 0 THEN (CASE WHEN a > 1 THEN '…' ELSE '' END) || substr(text, a, b - a + 1) || (CASE WHEN b < length(text) THEN '…' ELSE '' END) END AS snippet
    FROM cut WHERE rank <= 50""")
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of hits in each language."""
    rows = lines(table(spark, sf_dir, "documents")).select("lang", "doc_id", "line", F.col("text").alias("original_text"), F.lit(None).cast("string").alias("translated_text"))
    return reading.search(rows, "the", ["lang"], ["doc_id", "line"]).select("lang", "doc_id", "line", "rank", "has_more", "field", "snippet")


@query(f"""
    WITH {LINES_SQL},
    hit AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line)::INTEGER AS rank FROM lines WHERE contains(translate(text, '{text.UPPER}', '{text.LOWER}'), 'de'))
    SELECT lang, doc_id, line, rank, (SELECT count(*) FROM hit h WHERE h.lang = hit.lang) > 100 AS has_more FROM hit WHERE rank > 50 AND rank <= 100""")
def search_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(table(spark, sf_dir, "documents")).select("lang", "doc_id", "line", F.col("text").alias("original_text"), F.lit(None).cast("string").alias("translated_text"))
    return reading.search(rows, "de", ["lang"], ["doc_id", "line"], offset=50).select("lang", "doc_id", "line", "rank", "has_more")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("user_id"),
        F.when(key % 5 != 0, key % 10).alias("display_order"), key.alias("created_at"), F.when(key % 11 == 0, "processing").otherwise("ready").alias("status"),
    )


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(key.alias("id"), F.col("r_name").alias("shelf_id"), F.floor(key / 5).cast("long").alias("row"), (key % 5).alias("col"), key.alias("sort_order"), F.col("n_name").alias("label"), (key % 2).alias("is_public"))


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_acctbal > 4500").select(key.alias("book_id"), F.col("c_nationkey").alias("slot_id"), (key % 100).alias("position"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.lit(USER).alias("user_id"), key.alias("slot_id"), F.concat(F.lit("own "), key.cast("string")).alias("label"))


SHELF_SQL = """
    books AS (
        SELECT c_custkey AS id, c_name AS title, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END AS user_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 10 END AS display_order,
               c_custkey AS created_at, CASE WHEN c_custkey % 11 = 0 THEN 'processing' ELSE 'ready' END AS status FROM customer),
    slots AS (
        SELECT n_nationkey AS id, r_name AS shelf_id, (n_nationkey // 5)::BIGINT AS "row", n_nationkey % 5 AS col, n_nationkey AS sort_order, n_name AS label, n_nationkey % 2 AS is_public
        FROM nation JOIN region ON n_regionkey = r_regionkey),
    placements AS (SELECT c_custkey AS book_id, c_nationkey AS slot_id, c_custkey % 100 AS position FROM customer WHERE c_acctbal > 4500),
    labels AS (SELECT 7 AS user_id, n_nationkey AS slot_id, 'own ' || n_nationkey AS label FROM nation WHERE n_regionkey <> 1)"""


@query(f"""
    WITH {SHELF_SQL}, shelves AS (SELECT 'alt' AS shelf_id, c_custkey AS book_id, c_custkey % 50 AS position FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT b.id, b.title, b.user_id, coalesce(s.shelf_id, h.shelf_id) AS shelf_id, coalesce(p.position, h.position) AS shelf_position, s.id AS shelf_slot_id, s."row" AS shelf_row, s.col AS shelf_col,
           CASE WHEN s.is_public = 1 THEN s.label ELSE l.label END AS shelf_slot_label
    FROM books b LEFT JOIN placements p ON p.book_id = b.id LEFT JOIN slots s ON s.id = p.slot_id LEFT JOIN labels l ON l.slot_id = s.id AND l.user_id = 7 LEFT JOIN shelves h ON h.book_id = b.id
    WHERE b.user_id IS NULL OR b.user_id = 7""")
def shelf_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    shelves = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.lit("alt").alias("shelf_id"), key.alias("book_id"), (key % 50).alias("position"))
    rows = shelf.listing(_books(spark, sf_dir), _placements(spark, sf_dir), _slots(spark, sf_dir), _labels(spark, sf_dir), shelves, USER)
    return rows.select("id", "title", "user_id", "shelf_id", "shelf_position", "shelf_slot_id", "shelf_row", "shelf_col", "shelf_slot_label")


@query("SELECT c_custkey AS book_id, o_orderkey AS shelf_entry, o_orderpriority AS shelf_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def shelf_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book on several shelves is listed once for each."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("book_id"), F.col("o_orderkey").alias("shelf_entry"), F.col("o_orderpriority").alias("shelf_id"))


@query(f"WITH {SHELF_SQL} SELECT id, title, user_id FROM books WHERE user_id IS NULL OR user_id = 7")
def public_or_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.access(_books(spark, sf_dir), USER).where("accessible").select("id", "title", "user_id")


@query(f"""
    WITH {SHELF_SQL} SELECT s.id, s.shelf_id, s."row", s.col, s.sort_order, CASE WHEN s.is_public = 1 THEN s.label ELSE l.label END AS label, s.is_public
    FROM slots s LEFT JOIN labels l ON l.slot_id = s.id AND l.user_id = 7 WHERE s.shelf_id = 'ASIA'""")
def visible_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.slot_list(_slots(spark, sf_dir), _labels(spark, sf_dir), "ASIA", USER)


@query("""
    SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50""")
def transactions_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.history(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"])


@query("SELECT o_custkey AS user_id, o_orderkey AS session_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return limits.valid_sessions(sessions, users, F.lit("1997-01-01").cast("timestamp_ntz")).select("user_id", "session_id", "name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return table(spark, sf_dir, "lineitem").join(doomed, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.missing(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT s_nationkey AS user_id, s_suppkey AS slot_id FROM supplier UNION SELECT c_nationkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def distinct_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are put in where their key is not there yet."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    new = rows.select(F.col("c_nationkey").alias("user_id"), F.col("l_suppkey").alias("slot_id"))
    old = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user_id"), F.col("s_suppkey").alias("slot_id"))
    return mutation.insert_ignore(old, new, ["user_id", "slot_id"])


@query("""
    WITH held AS (SELECT l_partkey AS slot_id, CASE WHEN o_orderdate >= TIMESTAMP '1992-03-01' THEN o_custkey END AS owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    marked AS (SELECT p_partkey AS id, p_name AS label, EXISTS (SELECT 1 FROM held h WHERE h.slot_id = p_partkey AND h.owner IS NULL) AS public FROM part)
    SELECT DISTINCT h.owner AS user_id, h.slot_id, m.label FROM held h JOIN marked m ON m.id = h.slot_id WHERE h.owner IS NOT NULL AND NOT m.public""")
def migrated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of private slots move to the users whose books the slots hold: parts are slots, orders the books on them, the earliest public."""
    slots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit(0).alias("is_public"))
    placements = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slot_id"), F.col("l_orderkey").alias("book_id"))
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderdate") >= F.lit("1992-03-01").cast("timestamp_ntz"), F.col("o_custkey")).alias("user_id"))
    none = books.limit(0).select("user_id", F.col("id").alias("slot_id"), F.lit("").alias("label"))
    return mutation.migrated_labels(slots, placements, books, none)["labels"]


@query(f"""
    WITH {SHELF_SQL}, asked AS (SELECT n_nationkey AS request, (n_nationkey * 7) % 30 AS slot_id, (n_nationkey // 5)::BIGINT AS "row", n_nationkey % 6 AS col FROM nation)
    SELECT a.request, CASE WHEN coalesce(i.is_public, c.is_public, 0) = 0 THEN coalesce(i.id, c.id) END AS found
    FROM asked a LEFT JOIN slots i ON i.id = a.slot_id AND i."row" = a."row" AND i.col = a.col LEFT JOIN slots c ON c."row" = a."row" AND c.col = a.col""")
def slot_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(key.alias("request"), ((key * 7) % 30).alias("slot_id"), F.floor(key / 5).cast("long").alias("row"), (key % 6).alias("col"))
    return shelf.resolve_slot(asked, _slots(spark, sf_dir)).select("request", "found")


@query(f"""
    WITH {SHELF_SQL}, r AS (SELECT id, user_id IS NOT NULL AS own, row_number() OVER (PARTITION BY user_id IS NOT NULL ORDER BY id) - 1 AS pos FROM books)
    SELECT id, CASE WHEN NOT own OR pos < 12 THEN 0 ELSE 1 + (pos - 12) // 24 END::BIGINT AS page, CASE WHEN NOT own THEN 0 WHEN pos < 12 THEN 1 ELSE ((pos - 12) % 24) // 12 END::BIGINT AS page_row FROM r""")
def shelf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.pages(_books(spark, sf_dir), ["id"], 12).select("id", "page", "page_row")


@query("""
    WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS before FROM customer)
    SELECT c_custkey, CASE WHEN before IS NULL THEN c_acctbal - 0.5 ELSE (before + c_acctbal) / 2 END AS drop_position FROM r""")
def midpoint_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return shelf.midpoint_positions(rows, ["c_nationkey"], "c_acctbal", ["c_custkey"]).select("c_custkey", "drop_position")


@query("""
    WITH b AS (SELECT (n_nationkey // 5)::BIGINT AS "row", (n_nationkey % 5)::BIGINT AS col, count(*)::DOUBLE AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    g AS (SELECT r.x AS "row", c.x AS col FROM (SELECT unnest(range(min("row") - 1, max("row") + 2)) AS x FROM b) r, (SELECT unnest(range(min(col) - 1, max(col) + 2)) AS x FROM b) c)
    SELECT g."row", g.col, 1000.0::DOUBLE - coalesce(w, 0) AS remaining FROM g LEFT JOIN b ON g."row" = b."row" AND g.col = b.col WHERE 1000.0 - coalesce(w, 0) >= 5""")
def drop_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_nationkey") / 5).cast("long").alias("row"), (F.col("c_nationkey") % 5).cast("long").alias("col"))
    return shelf.drop_targets(shelf.bays(rows, F.lit(1.0)), 1000.0, 5.0)


@query("""
    SELECT (c_nationkey // 5)::BIGINT AS "row", (c_nationkey % 5)::BIGINT AS col, count(*) * 2.0::DOUBLE AS run_width, count(*) AS books FROM customer GROUP BY 1, 2""")
def bay_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_nationkey") / 5).cast("long").alias("row"), (F.col("c_nationkey") % 5).cast("long").alias("col"))
    return shelf.bays(rows, F.lit(2.0))


# -- aggregates ------------------------------------------------------------------------------------------------


@query("""
    SELECT c.conv_id, coalesce(t.n, 0)::BIGINT AS text_length FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN (SELECT conv_id, sum(length(text)) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) t USING (conv_id)""")
def chapter_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return reading.chapter_lengths(rows.select("conv_id").distinct(), rows.where(F.col("role") == "user"), "conv_id", "text")


@query("SELECT conv_id, count(*) AS found FROM conversations GROUP BY conv_id")
def rows_per_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id")
    return jobs.counted(rows.distinct(), rows, "conv_id")


@query("""
    WITH e AS (SELECT 'k' || user_id % 10 AS abuse_key, 'ip' || user_id % 5 AS ip, ts AS created_at FROM events), n AS (SELECT max(ts) AS now FROM events)
    SELECT coalesce(sum((abuse_key = 'k3' AND created_at > now - INTERVAL 15 MINUTE)::INTEGER), 0)::BIGINT AS key_15m, coalesce(sum((abuse_key = 'k3' AND created_at > now - INTERVAL 1 DAY)::INTEGER), 0)::BIGINT AS key_day,
           coalesce(sum((ip = 'ip3' AND created_at > now - INTERVAL 1 HOUR)::INTEGER), 0)::BIGINT AS ip_hour, coalesce(sum((ip = 'ip3' AND created_at > now - INTERVAL 1 DAY)::INTEGER), 0)::BIGINT AS ip_day,
           coalesce(sum((created_at > now - INTERVAL 1 DAY)::INTEGER), 0)::BIGINT AS all_day FROM e, n""")
def issuance_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    codes = events.select(F.concat(F.lit("k"), (F.col("user_id") % 10).cast("string")).alias("abuse_key"), F.concat(F.lit("ip"), (F.col("user_id") % 5).cast("string")).alias("ip"), F.col("ts").alias("created_at"))
    return limits.issuance_counters(codes, F.lit(events.agg(F.max("ts")).first()[0]), "k3", "ip3")


@query(f"""
    WITH {SHELF_SQL} SELECT slot_id, count(*) AS total, sum(CASE WHEN user_id = 7 THEN 1 ELSE 0 END)::BIGINT AS mine FROM placements JOIN books ON id = book_id GROUP BY slot_id""")
def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.occupancy(_placements(spark, sf_dir), _books(spark, sf_dir), USER)


@query("SELECT l_orderkey, (coalesce(max(l_linenumber), -1) + 1)::BIGINT AS next_ordinal FROM lineitem GROUP BY l_orderkey")
def next_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.next_ordinal(table(spark, sf_dir, "lineitem"), "l_linenumber", 0, ["l_orderkey"])


@query("""
    WITH s AS (SELECT count(*) AS total, sum((lang = 'en')::INTEGER)::BIGINT AS eligible, sum((lang = 'en' AND n_chars < 400)::INTEGER)::BIGINT AS flagged FROM documents)
    SELECT *, CASE WHEN total > 0 THEN flagged / total END AS share_of_all, CASE WHEN eligible > 0 THEN flagged / eligible END AS share_of_eligible FROM s""")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.flag_rates(table(spark, sf_dir, "documents").select("lang", "n_chars"), F.col("n_chars") < 400, F.col("lang") == "en")


@query("""
    SELECT source, sum(n_chars)::BIGINT AS characters, round(0.7 + sqrt(least(greatest((sum(n_chars) - 20000) / (200000 - 20000), 0.0), 1.0)), 9) AS thickness FROM documents GROUP BY source""")
def book_length_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("long").alias("characters"))
    return rows.withColumn("thickness", F.round(numbers.spine_thickness(F.col("characters"), 20_000, 200_000), 9))


@query("""
    WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most frequent words."""
    rows = table(spark, sf_dir, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)).alias("words"))
    return evaluation.top_words(rows, "words")


@query("SELECT min(n_nationkey // 5)::BIGINT AS min_row, max(n_nationkey // 5)::BIGINT AS max_row, min(n_nationkey % 5)::BIGINT AS min_col, max(n_nationkey % 5)::BIGINT AS max_col FROM nation")
def grid_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.extents(table(spark, sf_dir, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("long").alias("row"), (F.col("n_nationkey") % 5).cast("long").alias("col")))


# -- completeness and jobs -------------------------------------------------------------------------------------

PLAN_SQL = """
    u AS (SELECT o_orderkey, o_custkey, (o_orderkey % 6)::BIGINT AS expected FROM orders),
    f AS (SELECT u.*, coalesce(n, 0) AS found FROM u LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
    p AS (SELECT *, CASE WHEN expected = 0 OR expected = found THEN 'complete' WHEN found = 0 THEN 'pending' ELSE 'partial' END AS plan FROM f)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 6).cast("long").alias("expected"))
    return jobs.planned(jobs.counted(units, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"), "expected")


@query(f"WITH {PLAN_SQL} SELECT o_orderkey, expected, found, plan FROM p")
def plan_pending_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("o_orderkey", "expected", "found", "plan")


@query(f"""
    WITH {PLAN_SQL}, s AS (SELECT o_custkey, sum((plan <> 'complete')::INTEGER)::BIGINT AS incomplete, sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found FROM p GROUP BY 1)
    SELECT *, CASE WHEN incomplete > 0 THEN 'incomplete chapters' WHEN expected = 0 AND found = 0 THEN 'empty book' END AS fault FROM s""")
def finalize_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.finalize(_plan(spark, sf_dir), ["o_custkey"])


@query(f"WITH {PLAN_SQL} SELECT o_custkey, sum((plan = 'complete')::INTEGER)::BIGINT AS completed FROM p GROUP BY o_custkey")
def completed_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).groupBy("o_custkey").agg(F.sum(F.when(F.col("plan") == "complete", 1).otherwise(0)).alias("completed"))


@query(f"WITH {PLAN_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p WHERE plan = 'partial')")
def wiped_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return jobs.wiped(rows, _plan(spark, sf_dir).withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


def _status() -> Column:
    return F.element_at(F.lit(jobs.STATES), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))


STATUS_SQL = "['pending', 'extracting_glossary', 'translating', 'completed', 'error'][(event_id % 5 + 1)::INTEGER]"


@query(f"""
    WITH j AS (SELECT event_id AS job_id, {STATUS_SQL} AS status, ts AS updated_at FROM events),
    s AS (SELECT * FROM j WHERE status NOT IN ('completed', 'error') AND updated_at < TIMESTAMP '2024-01-20' - INTERVAL 5 MINUTE AND job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
    SELECT job_id, status, updated_at, row_number() OVER (ORDER BY updated_at, job_id)::INTEGER AS turn FROM s QUALIFY turn <= 100""")
def stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred jobs that are to be resumed first."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), _status().alias("status"), F.col("ts").alias("updated_at"))
    active = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("job_id"))
    return jobs.stalled(rows, active, F.lit("2024-01-20").cast("timestamp_ntz"), 100).select("job_id", "status", "updated_at", "turn")


@query(f"""
    WITH e AS (SELECT user_id, ts, event_id, {STATUS_SQL} AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
    n AS (SELECT before, status, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY 1, 2)
    SELECT *, before NOT IN ('completed', 'error') AND (status = 'error' OR list_position(['pending', 'extracting_glossary', 'translating', 'completed', 'error'], status)
              > list_position(['pending', 'extracting_glossary', 'translating', 'completed', 'error'], before)) AS legal FROM n""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.transitions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _status().alias("status")), "user_id", ["ts", "event_id"])


@query(f"SELECT user_id, arg_max({STATUS_SQL}, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _status().alias("status")), "user_id", ["ts", "event_id"])


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::BIGINT AS chunk FROM conversations")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.chunk_slices(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 2)


# -- ordered logic ---------------------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations),
    w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(n) OVER (PARTITION BY conv_id)::BIGINT AS total,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM c)
    SELECT conv_id, turn, least(100, round(CASE WHEN total > 0 THEN (before + 0.5::DOUBLE * n) / total ELSE (i + 0.5::DOUBLE) / k END * 100))::BIGINT AS percent FROM w""")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return reading.progress_percent(rows, ["conv_id"], "turn", "n", F.lit(0.5)).select("conv_id", "turn", "percent")


@query("SELECT conv_id, turn, percent_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS chapter_fraction FROM conversations")
def chapter_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.chapter_fraction(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""
    SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS before,
           coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)), '') AS after FROM conversations""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.context(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return rows.select("conv_id", "turn", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


@query("""
    WITH a AS (SELECT o_orderkey, (o_orderkey % 9)::INTEGER AS wanted FROM orders)
    SELECT o_orderkey, wanted, coalesce(max(CASE WHEN l_linenumber <= wanted THEN l_linenumber END), min(l_linenumber)) AS actual FROM a LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def clamp_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).cast("int").alias("wanted"))
    chapters = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return reading.nearest_chapter(asked, chapters, "o_orderkey", "l_linenumber", "wanted")


@query("""
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
    s AS (SELECT *, greatest(0, n // 2 - 2) AS m FROM r)
    SELECT doc_id, source, 'head' AS part FROM s WHERE pos < 5 UNION ALL SELECT doc_id, source, 'middle' FROM s WHERE pos >= m AND pos < m + 4 UNION ALL SELECT doc_id, source, 'tail' FROM s WHERE pos >= n - 3""")
def sample_head_mid_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_middle_tail(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 5, 4, 3)


@query("""
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang FROM r WHERE pos % greatest(1, n // 10) = 0 AND pos // greatest(1, n // 10) < 10""")
def judge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten evenly spaced documents of each language."""
    return sampling.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 10)


@query(f"""
    WITH {SHELF_SQL}, p AS (SELECT e.user_id, e.ts AS last_read_at, b.title AS uuid FROM events e JOIN books b ON b.id = e.event_id % 1000 AND b.status <> 'processing')
    SELECT user_id, uuid, last_read_at FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_read_at DESC, uuid) = 1""")
def most_recent_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _books(spark, sf_dir).select("id", F.col("title").alias("uuid"), "status")
    progress = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("last_read_at"), (F.col("event_id") % 1000).alias("book")).join(books.select("id", "uuid"), F.col("book") == F.col("id")).select("user_id", "uuid", "last_read_at")
    return reading.most_recent(progress, books, "user_id")


@query("""
    SELECT doc_id, source, last_value(CASE WHEN n_chars % 7 = 0 THEN 'T' || doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM documents""")
def title_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.carried_forward(rows, ["source"], ["doc_id"], F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string")))).select("doc_id", "source", "carried")


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS number FROM conversations")
def running_chapter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.running_number(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "number")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text")
def dedup_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the first; texts are compared by digest, so that only digests are shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")
