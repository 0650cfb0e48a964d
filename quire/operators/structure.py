"""Headings, paragraphs and blocks of a telling class, from flat rows of a page's tokens.

A page is cut into tokens, one row each; where an element ends is told by windows over the tokens (the next token that ends a paragraph or a heading; for a division the
close of its own level), and what it holds is the stretch of the page's text between two places.  Nothing builds a tree.  Content rules of the older reader: repeated
texts of a page, texts of one character and lines of navigation or rights are left out.

Comments, scripts and styles hold no text here.  A paragraph ends where a block begins or the element around it ends; a heading also where the next one begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: Classes that make a division a block of its own.
CLASSES = ["letter", "telegram", "note", "message", "quote", "dialogue", "poem", "verse", "monologue", "speech", "letter-address", "letter-block", "letter-signature"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Elements whose start ends a paragraph, and those whose end does.
STARTS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "ul", *HEADINGS,
]
ENDS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol",
    "section", "table", "td", "th", "tr", "ul",
]
#: A tag, with its quoted values, or a stretch of text, or a sign that opens nothing.
TOKEN = """<[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>|[^<]+|<"""


def body(html: Column) -> Column:
    """The markup after the head, without comments, scripts and styles."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?is)^.*?</head\s*>", ""), r"(?is)<title\b[^>]*>.*?</title\s*>|<!doctype[^>]*>", "")


def plain(text: Column) -> Column:
    """Text with its entities resolved once; white space stays."""
    for name, character in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def _attribute(token: Column, name: str) -> Column:
    """An attribute's value in a tag; null if it is not there or empty."""
    found = F.regexp_extract(token, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(found, r"(?is)^\s[a-z-]+\s*=\s*", ""), r"""^["']|["']$""", "")
    return F.nullif(value, F.lit(""))


def head(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title and styles of each page."""
    title = X.trimmed(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    styles = F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1))
    return pages.select(key, F.coalesce(title, F.lit("")).alias("title"), F.coalesce(F.array_join(F.transform(styles, lambda s: F.concat(X.trimmed(s), F.lit("\n"))), ""), F.lit("")).alias("styles"))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, i, token, tag (null for text), close, text, start: where a token's text begins in the page's text."""
    rows = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(body(F.col(html)), F.lit(TOKEN), F.lit(0))).alias("i", "token"))
    tag = F.nullif(F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)[^>]*", 1)), F.lit(""))
    rows = rows.withColumn("tag", F.when(F.col("token").endswith(">"), tag)).withColumn("close", F.col("token").startswith("</"))
    other = F.col("tag").isNull() & F.col("token").rlike("^<[!?/]")
    rows = rows.withColumn("text", F.when(F.col("tag").isNull() & ~other, plain(F.col("token"))).otherwise(""))
    at = Window.partitionBy("key").orderBy("i")
    return rows.withColumn("start", F.sum(F.length("text")).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text"))


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n (from 0), type (chapter or paragraph), content, class_name, tag_name, styles of the blocks of each page, in the order of its markup.  ``key`` must be unique."""
    rows = tokens(pages, key, html)
    back = Window.partitionBy("key").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    next_start = lambda what: F.last(F.when(what, F.col("start")), ignorenulls=True).over(back)
    opens, closes = ~F.col("close") & F.col("tag").isNotNull(), F.col("close") & F.col("tag").isNotNull()
    out_of = closes & F.col("tag").isin(ENDS)
    level = F.sum(F.when(F.col("tag") == "div", F.when(F.col("close"), -1).otherwise(1)).otherwise(0)).over(Window.partitionBy("key").orderBy("i"))
    rows = rows.withColumn("level", F.when(F.col("tag") == "div", level + F.when(F.col("close"), 1).otherwise(0)))
    own = Window.partitionBy("key", "level").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("p_end", next_start(out_of | (closes & (F.col("tag") == "p")) | (opens & F.col("tag").isin(STARTS))))
    rows = rows.withColumn("h_end", next_start(out_of | (F.col("tag").isin(HEADINGS))))
    ended = F.last(F.when(closes & (F.col("tag") == "div"), F.col("start")), ignorenulls=True).over(own)
    # Only divisions have a level; all other tokens of a page would be one group, so they are left out of that window.
    div = rows.where(F.col("tag") == "div").withColumn("end", ended)
    rest = rows.where(opens & F.col("tag").isin("p", *HEADINGS)).withColumn("end", F.when(F.col("tag") == "p", F.col("p_end")).otherwise(F.col("h_end")))
    name = F.lower(_attribute(F.col("token"), "class"))
    told = F.coalesce(F.exists(F.lit(CLASSES), lambda c: F.contains(name, c)), F.lit(False))
    found = rest.unionByName(div.where(opens & told)).select("key", "i", "tag", "start", "end", name.alias("class_name"), _attribute(F.col("token"), "style").alias("styles"))
    whole = rows.where("text <> ''").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda t: t["text"]), "").alias("whole"))
    held = found.join(whole, "key")
    stretch = F.substring("whole", (F.col("start") + 1).cast("int"), (F.coalesce("end", F.length("whole").cast("long")) - F.col("start")).cast("int"))
    held = held.select("key", "i", "tag", "class_name", "styles", F.regexp_replace(stretch, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "").alias("content"))
    kept = held.where((F.length("content") >= 2) & ~X.is_navigation_or_rights(F.col("content")))
    first = kept.withColumn("k", F.row_number().over(Window.partitionBy("key", "content").orderBy("i"))).where("k = 1")
    n = F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1
    kind = F.when(F.col("tag").isin(HEADINGS), "chapter").otherwise("paragraph")
    return first.select(F.col("key").alias(key), n.alias("n"), kind.alias("type"), "content", "class_name", F.col("tag").alias("tag_name"), "styles")
