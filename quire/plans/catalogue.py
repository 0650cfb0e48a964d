"""Catalogue, sharing, guards, page heuristics and small text rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions import residue as R
from quire.functions import text as X
from quire.operators import accounts, evaluation, jobs, mutation, ranks, reading, shelf
from quire.plans.registry import query
from quire.plans.texts import _citations_sql
from quire.sources import scripts
from quire.sources.tables import lines, table


@query("""
    SELECT o_orderkey AS uuid, CASE WHEN length(t) > 25 THEN substr(t, 1, 22) || '...' ELSE t END AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS imported,
           row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place
    FROM (SELECT *, o_orderpriority || ' order of ' || o_custkey || ' at ' || o_totalprice::BIGINT AS t FROM orders)""")
def catalogue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books, newest first, with short titles; the order is there as ``place``."""
    title = F.concat("o_orderpriority", F.lit(" order of "), F.col("o_custkey").cast("string"), F.lit(" at "), F.round("o_totalprice").cast("long").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), X.truncate(title, 25).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("imported"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"))
    return ranks.numbered(rows, [], ["age", "uuid"]).select("uuid", "title", "imported", F.col("at").cast("long").alias("place"))


@query("""
    SELECT c_custkey AS book, c_name AS title, coalesce(n, 0)::BIGINT AS chapters, coalesce(m, 0)::BIGINT AS translations
    FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""")
def removal_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would go with each book: its chapters and their translations."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"))
    chapters = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    sums = chapters.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.coalesce("m", F.lit(0))).alias("m"))
    rows = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0).cast("long")
    return rows.select(F.col("c_custkey").alias("book"), F.col("c_name").alias("title"), F.coalesce("n", zero).alias("chapters"), F.coalesce("m", zero).alias("translations"))


@query(f"""
    WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS o, CASE WHEN role <> 'user' THEN text END AS t FROM conversations),
    hit AS (SELECT *, coalesce(contains(translate(o, '{X.UPPER}', '{X.LOWER}'), 'the'), FALSE) AS in_o, coalesce(o, t) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS rank FROM r
            WHERE contains(translate(o, '{X.UPPER}', '{X.LOWER}'), 'the') OR contains(translate(t, '{X.UPPER}', '{X.LOWER}'), 'the')),
    cut AS (SELECT *, instr(lower(s), 'the') AS pos FROM hit)
    SELECT conv_id, turn, rank, CASE WHEN in_o THEN 'original' ELSE 'translated' END AS field,
           CASE WHEN pos > 0 THEN (CASE WHEN pos > 41 THEN '…' ELSE '' END) || substr(s, greatest(1, pos - 40), least(length(s), pos + 42) - greatest(1, pos - 40) + 1) || (CASE WHEN pos + 42 < length(s) THEN '…' ELSE '' END) END AS snippet
    FROM cut WHERE rank <= 3""")
def search_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in originals or translations, three of each book."""
    user = F.col("role") == "user"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(user, F.col("text")).alias("original_text"), F.when(~user, F.col("text")).alias("translated_text"))
    return reading.search(rows, "the", ["conv_id"], ["turn"], limit=3).select("conv_id", "turn", "rank", "field", "snippet")


COMMON = ["herself", "window", "nothing", "onwh", "thing"]


@query(f"""
    WITH d AS (SELECT doc_id, repeat('书', 2 * length(text) + 100) || ' ' || replace(replace(text, '''', ''), '"', '') || ' “quoted wording” (noted wording)' AS t FROM documents),
    s AS (SELECT doc_id, {_citations_sql('t')} AS s FROM d),
    w AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '“[^”]{{0,120}}”', ' ', 'g'), '‘[^’]{{0,120}}’', ' ', 'g'), '（[^）]{{0,120}}）', ' ', 'g'), '\\([^)]{{0,120}}\\)', ' ', 'g'), '[a-zA-Z]{{3,}}') AS w FROM s),
    k AS (SELECT doc_id, list_filter(w, lambda x: regexp_full_match(x, '[a-z]+') AND NOT list_contains({R.LET_THROUGH}, x) AND (list_contains({COMMON}, x) OR regexp_matches(x, '{R.SHAPES[0]}|{R.SHAPES[1]}|{R.SHAPES[2]}'))) AS k FROM w)
    SELECT doc_id, len(k)::BIGINT AS n, k[1] AS first, k[-1] AS last FROM k""")
def cjk_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English left in mostly Chinese texts: words of the list and inflected ones; short quotations are passed over."""
    plain = F.replace(F.replace("text", F.lit("'"), F.lit("")), F.lit('"'), F.lit(""))
    text = F.concat(F.repeat(F.lit("书"), 2 * F.length("text") + 100), F.lit(" "), plain, F.lit(" “quoted wording” (noted wording)"))
    rows = table(spark, sf_dir, "documents").select("doc_id", R.residue(text, COMMON).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"))


@query("""
    WITH l AS (SELECT doc_id, u.i AS i, string_split(text, chr(10))[u.i] AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
    SELECT doc_id, '/body[1]/p[' || i || ']' AS xpath, t AS text, (i - 1)::INTEGER AS order_index FROM l""")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes out of a JSON array column, with the field that they are sorted by."""
    node = lambda t, i: F.struct(F.concat(F.lit("/body[1]/p["), (i + 1).cast("string"), F.lit("]")).alias("xpath"), t.alias("text"), i.alias("orderIndex"))
    chapters = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.transform(F.split("text", "\n"), node)).alias("nodes"))
    return reading.node_rows(chapters, "nodes").select("doc_id", "xpath", "text", "order_index")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment || ':' || c_custkey LIKE 'BUILDING:%'")
def prefixed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose id begins with a mark."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "email").otherwise("other"), F.lit(":"), F.col("c_custkey").cast("string")).alias("google_id"))
    return accounts.email_born(rows).select("user_id")


@query("""
    WITH w AS (SELECT o_custkey, max(o_orderkey) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c_custkey AS book, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'old' || c_custkey ELSE 't' || t END AS share_token FROM customer LEFT JOIN w ON o_custkey = c_custkey""")
def share_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are given where there is none, kept where there is one, and taken from books that are shared no more."""
    uuid = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"), uuid.alias("uuid"), F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("old"), F.col("c_custkey").cast("string"))).alias("share_token"), "c_acctbal")
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("t"))
    wanted = last.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("uuid"), F.concat(F.lit("t"), F.col("t").cast("string")).alias("token"))
    return accounts.without_tokens(accounts.with_token(books, wanted), books.where("c_acctbal < 0").select("uuid")).select("book", "share_token")


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public' WHEN c_nationkey <> 7 THEN 'not the owner' END AS refusal FROM customer")
def owner_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a user may not change a book, or null."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("user_id"))
    return mutation.guarded_change(rows, 7).select("id", "refusal")


@query("""
    WITH o AS (SELECT n_nationkey AS slot_id, n_name AS label FROM nation), c AS (SELECT c_nationkey AS slot_id, arg_max(CASE WHEN c_acctbal > 0 THEN c_name END, c_custkey) FILTER (TRUE) AS x, max(c_custkey) AS k FROM customer GROUP BY 1),
    l AS (SELECT c_nationkey AS slot_id, CASE WHEN c_acctbal > 0 THEN c_name END AS label FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1)
    SELECT coalesce(l.slot_id, o.slot_id) AS slot_id, CASE WHEN l.slot_id IS NULL THEN o.label ELSE l.label END AS label FROM o FULL JOIN l ON o.slot_id = l.slot_id
    WHERE CASE WHEN l.slot_id IS NULL THEN o.label ELSE l.label END IS NOT NULL""")
def upsert_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is set or replaced by the last change, and goes when that is null."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slot_id"), F.col("n_name").alias("label"))
    last = F.max_by(F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("x")), "c_custkey")
    changes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("slot_id")).agg(last["x"].alias("label"))
    return mutation.upsert_or_delete(old, changes, ["slot_id"], "label")


@query("""
    SELECT p_partkey, replace(replace(replace(p_name || '%_' || chr(92), chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS liked,
           CASE WHEN length(p_type) > 16 THEN substr(p_type, 1, 13) || '...' ELSE p_type END AS short, 'Tom & ' || p_name || ' <b> “书”' AS decoded, (2.0::DOUBLE * pow(3.0::DOUBLE, p_size % 5)) AS backoff
    FROM part""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with their wildcards escaped, cut titles, decoded entities and waits between attempts."""
    coded = F.concat(F.lit("Tom&nbsp;&amp; "), "p_name", F.lit("  &lt;b&gt;\n&#8220;&#20070;&#8221; "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.escape_like(F.concat("p_name", F.lit("%_\\"))).alias("liked"), X.truncate(F.col("p_type"), 16).alias("short"), X.decode_entities(coded).alias("decoded"),
        numbers.backoff_seconds(F.col("p_size") % 5, 2.0, 3.0).alias("backoff"),
    )


@query("""
    WITH w AS (SELECT s_suppkey, 1 + s_suppkey % 4 AS a, s_nationkey % 4 AS b FROM supplier)
    SELECT s_suppkey, b < a AS keeps, (SELECT count(*) FROM part WHERE p_brand = 'Brand#' || s_nationkey)::BIGINT AS fixes FROM supplier JOIN w USING (s_suppkey)""")
def retry_and_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second answer stays, and how many texts a consistency pass changes for each supplier's variant."""
    words = lambda n: F.array_repeat(F.lit("w"), n.cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", R.keeps_retry(words(1 + F.col("s_suppkey") % 4), words(F.col("s_nationkey") % 4)).alias("keeps"))
    fixed = table(spark, sf_dir, "part").select("p_brand", evaluation.canonical(F.col("p_brand"), {"Brand#": "B"}).alias("after"))
    counts = fixed.groupBy("p_brand").agg(evaluation.fix_count(F.col("p_brand"), F.col("after")).alias("n"))
    joined = rows.join(counts, F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")) == F.col("p_brand"), "left")
    return joined.select("s_suppkey", "keeps", F.coalesce("n", F.lit(0).cast("long")).alias("fixes"))


@query("""
    SELECT event_type, count(*) AS jobs, sum((value < 50 AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 4 HOUR)::INTEGER)::BIGINT AS timed_out FROM events GROUP BY 1""")
def timed_out_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that run for more than four hours, by kind."""
    status = F.when(F.col("value") < 50, "translating").otherwise(jobs.FINAL[0])
    rows = table(spark, sf_dir, "events").select("event_type", status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    late = jobs.timed_out(rows, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return late.groupBy("event_type").agg(F.count("*").alias("jobs"), F.sum(F.col("timed_out").cast("int")).alias("timed_out"))


NAV_SQL = " OR ".join(f"contains(s, '{w}')" for w in X.NAVIGATION)
RIGHTS_SQL = " OR ".join(f"contains(s, '{w}')" for w in X.RIGHTS)


@query(f"""
    WITH l AS (SELECT doc_id, (u.i - 1)::INTEGER AS line, string_split(text, chr(10))[u.i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE trim(string_split(text, chr(10))[u.i]) <> ''),
    s AS (SELECT doc_id, lower(trim(text)) AS s FROM l)
    SELECT doc_id, count(*) AS lines, sum(((length(s) < 50 AND ({NAV_SQL})) OR (length(s) < 300 AND ({RIGHTS_SQL})))::INTEGER)::BIGINT AS navigation FROM s GROUP BY doc_id""")
def navigation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each text are navigation or statements of rights."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", X.is_navigation_or_rights(F.col("text")).cast("int").alias("hit"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("hit").alias("navigation"))


@query("""
    WITH p AS (SELECT page_id, html || '<img alt="x" src="../a/' || page_id || '.png"/><img src="k.png">' AS h FROM pages)
    SELECT page_id, md5(replace(replace(h, 'src="../a/' || page_id || '.png"', 'src="s' || page_id || '"'), 'src="k.png"', 'src="kept"')) AS html_hash,
           strlen(html) > 0 AND strlen(html) < 50000 AS stored FROM p JOIN pages USING (page_id)""")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with stored image sources, and whether their markup is short enough to be stored."""
    key = F.col("page_id").cast("string")
    html = F.concat("html", F.lit('<img alt="x" src="../a/'), key, F.lit('.png"/><img src="k.png">'))
    stored = F.create_map(F.concat(key, F.lit(".png")), F.concat(F.lit("s"), key), F.lit("k.png"), F.lit("kept"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.with_image_sources(html, stored)).alias("html_hash"), X.stored_html(F.col("html")).isNotNull().alias("stored"))


@query("""
    WITH f AS (SELECT p_partkey, 'OEBPS/v2/part' || CASE WHEN p_size > 5 THEN p_size::VARCHAR ELSE '' END || 'x.html' AS path, CASE WHEN p_size > 5 THEN p_size END AS n FROM part)
    SELECT p_partkey, n::BIGINT AS number, row_number() OVER (ORDER BY n IS NULL, n, p_partkey) - 1 AS place FROM f""")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of the last number in their names, those without one last."""
    path = F.concat(F.lit("OEBPS/v2/part"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise(""), F.lit("x.html"))
    rows = table(spark, sf_dir, "part").select("p_partkey", X.file_number(path).alias("number")).withColumn("last", F.col("number").isNull())
    return ranks.numbered(rows, [], ["last", "number", "p_partkey"]).select("p_partkey", "number", F.col("at").cast("long").alias("place"))


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, string_agg(event_id, ',' ORDER BY k DESC) AS stack FROM r WHERE k <= 5 GROUP BY user_id""")
def return_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five places of each user, the latest last."""
    return reading.last_places(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", 5).select("user_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("stack"))


@query("""
    SELECT doc_id, regexp_matches(text, '[a-z]{3}') AND coalesce(text, '') <> '' AS candidate, lang || '-zh' LIKE '%-zh' AS to_chinese FROM documents""")
def residue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backfill looks at: texts with three lower-case letters in a row, of books translated to Chinese."""
    pair = F.concat("lang", F.lit("-zh"))
    return table(spark, sf_dir, "documents").select("doc_id", R.is_candidate(F.col("text")).alias("candidate"), pair.endswith("-zh").alias("to_chinese"))


SECRET = "s3cret"
_PADS = [bytes(b ^ n for b in SECRET.encode().ljust(64, b"\0")).hex() for n in (0x36, 0x5C)]


@query(f"""
    SELECT event_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || (floor(epoch(ts))::BIGINT || '.' || event_type)::BLOB))) AS signature,
           abs(epoch(TIMESTAMP '2024-01-05')::BIGINT - floor(epoch(ts))::BIGINT) <= 300 AS in_time FROM events""")
def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature that each event must carry, and whether its stamp is within the tolerance."""
    stamp = F.unix_seconds(F.col("ts").cast("timestamp"))
    near = F.abs(F.unix_seconds(F.lit("2024-01-05").cast("timestamp")) - stamp) <= 300
    return table(spark, sf_dir, "events").select("event_id", X.signature(F.col("event_type"), stamp.cast("string"), SECRET).alias("signature"), near.alias("in_time"))


@query("""
    WITH b AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'processing' WHEN s_nationkey < 5 THEN 'error' WHEN s_nationkey < 20 THEN 'ready' END AS status, s_nationkey < 12 AS art, s_nationkey >= 8 AS translated FROM supplier)
    SELECT s_suppkey, coalesce(status = 'processing', FALSE) AS import_pending, coalesce(status <> 'error', TRUE) AND NOT art AS artwork_pending, coalesce(status = 'processing', FALSE) AND translated AS needs_drive FROM b""")
def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which books are being imported, lack pictures, or have a translation that must be kept going."""
    status = F.when(F.col("s_acctbal") < 0, "processing").when(F.col("s_nationkey") < 5, "error").when(F.col("s_nationkey") < 20, "ready")
    spine, pair = F.when(F.col("s_nationkey") < 12, F.lit("s.png")), F.when(F.col("s_nationkey") < 8, "en-none").otherwise("en-zh")
    return table(spark, sf_dir, "supplier").select("s_suppkey", *jobs.import_states(status, F.lit("c.png"), spine, pair))


@query("""
    SELECT c_custkey AS book, 'DELETE FROM books WHERE id = ' || c_custkey || ';' AS gone,
           'INSERT INTO books (id, title, owner) VALUES (' || c_custkey || ', ''' || c_name || '''''s'', ' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey::VARCHAR ELSE 'NULL' END || ');' AS put FROM customer""")
def book_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book as the statements that put it into another database, taken apart again."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("'s")).alias("title"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("owner"))
    told = scripts.replacing(rows, "books", "id")
    script = F.concat(F.lit("-- a book\n"), F.array_join("statements", "\n"), F.lit("\n  -- end;\n"))
    parts = told.select("id", scripts.split(script).alias("s"))
    return parts.select(F.col("id").alias("book"), F.concat(F.col("s")[0], F.lit(";")).alias("gone"), F.concat(F.col("s")[1], F.lit(";")).alias("put"))


@query("""
    WITH k AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/../../' ELSE 'a/../' END || regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') AS key FROM pages),
    s AS (SELECT page_id, key, list_transform(string_split(replace(key, chr(92), '/'), '/'), lambda p: CASE WHEN p = '..' THEN -1 WHEN p IN ('', '.') THEN 0 ELSE 1 END) AS steps FROM k),
    d AS (SELECT page_id, key, list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1 : i])) AS depths FROM s)
    SELECT page_id, key <> '' AND NOT starts_with(key, '/') AND list_min(depths) >= 0 AND depths[-1] > 0 AS inside FROM d""")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paths made of the pages' addresses may be keys of stored objects."""
    key = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("a/../../")).otherwise(F.lit("a/../")), F.regexp_replace("url", "[^a-zA-Z0-9]", "_"))
    return table(spark, sf_dir, "pages").select("page_id", scripts.inside_store(key).alias("inside"))


@query("""
    WITH s AS (SELECT n_regionkey, (n_nationkey // 5)::BIGINT AS r, n_nationkey % 5 AS c, n_nationkey AS o FROM nation),
    w AS (SELECT DISTINCT c_nationkey % 5 AS n_regionkey, (c_custkey % 7)::BIGINT AS r, (c_custkey % 3)::INTEGER AS c FROM customer),
    n AS (SELECT w.*, row_number() OVER (PARTITION BY w.n_regionkey ORDER BY w.r, w.c) AS k FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n_regionkey = w.n_regionkey AND s.r = w.r AND s.c = w.c))
    SELECT n_regionkey AS shelf_id, r AS "row", c AS col, o::BIGINT AS sort_order FROM s
    UNION ALL SELECT n_regionkey, r, c, coalesce((SELECT max(o) FROM s WHERE s.n_regionkey = n.n_regionkey), -1) + k FROM n""")
def created_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that readers ask for are created once, after the others of their shelf."""
    key, book = F.col("n_nationkey"), F.col("c_custkey")
    slots = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("shelf_id"), F.floor(key / 5).cast("long").alias("row"), (key % 5).alias("col"), key.cast("long").alias("sort_order"), F.col("n_name").alias("label"))
    wanted = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("shelf_id"), (book % 7).alias("row"), (book % 3).cast("int").alias("col"))
    return shelf.created_slots(slots, wanted).select("shelf_id", "row", "col", "sort_order")
