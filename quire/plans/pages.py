"""HTML pages: blocks, links and rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import reading
from quire.operators import structure as S
from quire.plans.registry import query
from quire.sources.html import BLOCKS, EMPTY, leaf_blocks
from quire.sources.tables import table

PARAGRAPH = r"(?s)<p\b[^>]*>(.*?)</p>"


@query(r"""
    WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p\b[^>]*>(.*?)</p>', 1)) AS inner_html, generate_subscripts(regexp_extract_all(html, '(?s)<p\b[^>]*>(.*?)</p>', 1), 1) - 1 AS pos FROM pages),
    t AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(inner_html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM b)
    SELECT page_id, pos::INTEGER AS pos, text FROM t WHERE length(text) >= 2 QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY pos) = 1""")
def regex_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by pattern, of equal texts of a page the first."""
    found = F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "inner"))
    rows = rows.select("page_id", "pos", F.trim(F.regexp_replace(F.regexp_replace("inner", "<[^>]+>", ""), r"\s+", " ")).alias("text")).where(F.length("text") >= 2)
    first = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


@query(r"""SELECT page_id, md5(regexp_replace(html, '(?is)<a\s+[^>]*href\s*=\s*["''][^"'']*["''][^>]*>(.*?)</a>', '\1', 'g')) AS html_hash FROM pages""")
def strip_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their internal links; no link of the pages is external, so all go."""
    plain = F.regexp_replace("html", r"(?is)<a\s+[^>]*href\s*=\s*[\"'](?!https?://)[^\"']*[\"'][^>]*>(.*?)</a>", "$1")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("html_hash"))


@query("""
    WITH p AS (SELECT conv_id, turn, '/body[1]/' || CASE WHEN role = 'user' THEN 'h2' ELSE 'p' END || '[' || turn || ']' AS xpath, CASE WHEN role = 'user' THEN 'h2' ELSE 'p' END AS tag, replace(text, '<', '') AS text FROM conversations)
    SELECT conv_id, string_agg('<' || tag || ' data-xpath="' || xpath || '">' || text || '</' || tag || '>', chr(10) ORDER BY turn) AS raw_html FROM p GROUP BY conv_id""")
def reconstruct_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's markup from its paragraphs and their paths."""
    tag = F.when(F.col("role") == "user", "h2").otherwise("p")
    path = F.concat(F.lit("/body[1]/"), tag, F.lit("["), F.col("turn").cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("xpath"), F.replace("text", F.lit("<"), F.lit("")).alias("text"))
    return reading.html_of(rows, ["conv_id"], "xpath", ["turn"], F.col("text"))


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _last(tag: str) -> str:
    """The place of the last open element of a name, 0 without one."""
    return f"coalesce(list_max(list_filter(range(1, len(tags) + 1), lambda k: tags[k] = {tag})), 0)"


BLOCK_LIST = f"[{_quoted(sorted(BLOCKS))}]"
#: Leaf blocks of the pages by a walk over their tokens with a stack of open elements; of the implied ends, those of paragraphs and list items, which are all that the pages have.
LEAVES_SQL = rf"""
    b AS (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)^.*?<body\b[^>]*>', ''), '<[a-zA-Z/!][^<>]*$', '') AS b FROM pages),
    k AS (SELECT page_id, regexp_extract_all(b, '<[^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>|[^<]+|<') AS k FROM b),
    u AS (SELECT page_id, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS token FROM k),
    t AS (
        SELECT *, CASE WHEN token LIKE '<%>' THEN lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag, token LIKE '</%' AS ends,
               regexp_replace(replace(replace(replace(replace(token, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&nbsp;', chr(160)), '&amp;?', '&', 'g') AS text FROM u),
    w AS (
        SELECT page_id, 0::BIGINT AS i, []::BIGINT[] AS ids, []::VARCHAR[] AS tags FROM pages
        UNION ALL
        SELECT page_id, i,
               CASE WHEN tag IS NULL THEN ids WHEN ends THEN CASE WHEN hit > 0 THEN ids[1 : hit - 1] ELSE ids END WHEN tag IN ({_quoted(sorted(EMPTY))}) THEN left_ids ELSE list_append(left_ids, i) END,
               CASE WHEN tag IS NULL THEN tags WHEN ends THEN CASE WHEN hit > 0 THEN tags[1 : hit - 1] ELSE tags END WHEN tag IN ({_quoted(sorted(EMPTY))}) THEN left_tags ELSE list_append(left_tags, tag) END
        FROM (
            SELECT *, CASE WHEN gone > 0 THEN ids[1 : gone - 1] ELSE ids END AS left_ids, CASE WHEN gone > 0 THEN tags[1 : gone - 1] ELSE tags END AS left_tags
            FROM (
                SELECT t.page_id, t.i, t.tag, t.ends, ids, tags, {_last("t.tag")} AS hit,
                       CASE WHEN t.tag = 'li' AND {_last("'li'")} > 0 AND len(list_filter(tags[{_last("'li'")} + 1 :], lambda x: x IN ('ul', 'ol'))) = 0 THEN {_last("'li'")}
                            WHEN list_contains({BLOCK_LIST}, t.tag) AND {_last("'p'")} > 0 AND len(list_filter(tags[{_last("'p'")} + 1 :], lambda x: list_contains({BLOCK_LIST}, x))) = 0 THEN {_last("'p'")} ELSE 0 END AS gone
                FROM w JOIN t ON t.page_id = w.page_id AND t.i = w.i + 1))),
    e AS (
        SELECT t.page_id, t.i, t.tag, w.ids[1 : -2] AS above, coalesce(w.ids[-2], 0) AS parent, row_number() OVER (PARTITION BY t.page_id, coalesce(w.ids[-2], 0), t.tag ORDER BY t.i) AS n
        FROM t JOIN w ON w.page_id = t.page_id AND w.i = t.i WHERE t.tag IS NOT NULL AND NOT t.ends AND t.tag NOT IN ({_quoted(sorted(EMPTY))})),
    p AS (SELECT e.*, list_contains({BLOCK_LIST}, tag) AND NOT EXISTS (SELECT 1 FROM e c WHERE c.page_id = e.page_id AND c.parent = e.i AND list_contains({BLOCK_LIST}, c.tag)) AS low FROM e),
    l AS (SELECT p.* FROM p WHERE low AND NOT EXISTS (SELECT 1 FROM p o WHERE o.page_id = p.page_id AND o.low AND list_contains(p.above, o.i))),
    x AS (SELECT l.page_id, l.i, string_agg('/' || o.tag || '[' || o.n || ']', '' ORDER BY o.i) AS path FROM l JOIN e o ON o.page_id = l.page_id AND (o.i = l.i OR list_contains(l.above, o.i)) GROUP BY 1, 2),
    s AS (
        SELECT l.page_id, l.i, l.tag, '/body[1]' || x.path AS xpath,
               coalesce((SELECT trim(regexp_replace(string_agg(t.text, '' ORDER BY t.i), '[\s\x{{A0}}]+', ' ', 'g')) FROM t JOIN w ON w.page_id = t.page_id AND w.i = t.i WHERE t.page_id = l.page_id AND t.tag IS NULL AND list_contains(w.ids, l.i)), '') AS text
        FROM l JOIN x ON x.page_id = l.page_id AND x.i = l.i),
    leaf_rows AS (SELECT page_id, i, xpath, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS order_index FROM s WHERE length(text) >= 2)"""


@query(f"WITH RECURSIVE {LEAVES_SQL} SELECT page_id, order_index::INTEGER AS order_index, xpath, tag, text FROM leaf_rows")
def dom_leaf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf blocks of every page with their paths."""
    return leaf_blocks(table(spark, sf_dir, "pages"), ["page_id"], "html").select("page_id", "order_index", "xpath", "tag", "text")


@query(rf"""
    WITH RECURSIVE {LEAVES_SQL},
    a AS (
        SELECT t.page_id, regexp_replace(regexp_extract(t.token, 'href="([^"]*)"', 1), '&amp;?', '&', 'g') AS href
        FROM t JOIN w ON w.page_id = t.page_id AND w.i = t.i JOIN leaf_rows l ON l.page_id = t.page_id AND list_contains(w.ids, l.i) WHERE t.tag = 'a' AND NOT t.ends AND t.token LIKE '% href="_%')
    SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM a GROUP BY href""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the leaf blocks, by where they lead."""
    rows = leaf_blocks(table(spark, sf_dir, "pages"), ["page_id"], "html").select("page_id", F.explode("links").alias("link"))
    return rows.groupBy("link.href").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"WITH RECURSIVE {LEAVES_SQL} SELECT page_id, tag, count(*) AS blocks, sum(length(text))::BIGINT AS characters FROM leaf_rows GROUP BY page_id, tag")
def page_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and characters of each page by element."""
    rows = leaf_blocks(table(spark, sf_dir, "pages"), ["page_id"], "html")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


@query(rf"""
    WITH b AS (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)^.*?</head\s*>', ''), '(?is)<title\b[^>]*>.*?</title\s*>|<!doctype[^>]*>', '', 'g') AS b
        FROM pages),
    k AS (SELECT page_id, regexp_extract_all(b, '<[^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>|[^<]+|<') AS k FROM b),
    u AS (SELECT page_id, unnest(range(len(k))) AS i, unnest(k) AS token FROM k),
    g AS (SELECT *, CASE WHEN token LIKE '%>' THEN nullif(lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)), '') END AS tag, token LIKE '</%' AS close FROM u),
    t AS (
        SELECT *, CASE WHEN tag IS NULL AND NOT regexp_matches(token, '^<[!?/]')
                  THEN replace(replace(replace(replace(replace(replace(replace(token, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') ELSE '' END AS text,
               sum(CASE WHEN tag = 'div' THEN CASE WHEN close THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS level
        FROM g),
    o AS (
        SELECT *, nullif(lower(regexp_extract(token, '(?i)\sclass\s*=\s*"([^"]*)"', 1)), '') AS class_name, nullif(regexp_extract(token, '(?i)\sstyle\s*=\s*"([^"]*)"', 1), '') AS styles
        FROM t WHERE NOT close AND tag IN ('p', 'div', {_quoted(S.HEADINGS)})),
    e AS (
        SELECT o.page_id, o.i, min(x.i) AS stop FROM o JOIN t x ON x.page_id = o.page_id AND x.i > o.i
        WHERE CASE WHEN o.tag = 'div' THEN x.tag = 'div' AND x.close AND x.level = o.level - 1
                   WHEN o.tag = 'p' THEN (x.close AND x.tag IN ('p', {_quoted(S.ENDS)})) OR (NOT x.close AND x.tag IN ({_quoted(S.STARTS)}))
                   ELSE (x.close AND x.tag IN ({_quoted(S.ENDS)})) OR x.tag IN ({_quoted(S.HEADINGS)}) END
        GROUP BY o.page_id, o.i),
    c AS (
        SELECT o.page_id, o.i, o.tag, o.class_name, o.styles, regexp_replace(string_agg(x.text, '' ORDER BY x.i), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS content
        FROM o LEFT JOIN e ON e.page_id = o.page_id AND e.i = o.i JOIN t x ON x.page_id = o.page_id AND x.i > o.i AND x.i < coalesce(e.stop, 1000000000)
        WHERE o.tag <> 'div' OR len(list_filter([{_quoted(S.CLASSES)}], lambda w: contains(o.class_name, w))) > 0
        GROUP BY ALL),
    l AS (SELECT *, lower(trim(content)) AS low FROM c WHERE length(content) >= 2),
    f AS (
        SELECT * FROM l
        WHERE NOT ((length(low) < 50 AND len(list_filter([{_quoted(X.NAVIGATION)}], lambda w: contains(low, w))) > 0) OR (length(low) < 300 AND len(list_filter([{_quoted(X.RIGHTS)}], lambda w: contains(low, w))) > 0))
        QUALIFY row_number() OVER (PARTITION BY page_id, content ORDER BY i) = 1)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS n, CASE WHEN tag IN ({_quoted(S.HEADINGS)}) THEN 'chapter' ELSE 'paragraph' END AS type, content, class_name, tag AS tag_name, styles FROM f""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and telling divisions of every page, without a tree."""
    return S.blocks(table(spark, sf_dir, "pages"), "page_id", "html")
