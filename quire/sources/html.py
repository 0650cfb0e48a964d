"""HTML pages to ordered leaf blocks with stable element paths.

One pass a page gives flat rows of nodes: an element's or a text's place in the document, its parent, and the last place below it.  The tokens come from the standard
library's parser; how open elements close is decided by a stack of places: a block's start closes an open paragraph, list items, cells and rows close their like, end
tags close the nearest open element of their name and are ignored without one.  All else is windows, joins and aggregates over the rows: sibling ordinals and paths, which
blocks are leaves, texts, markup, links, paragraphs divided by line breaks, and whose an anchor is.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import staged

# Elements that hold paragraphs, that are passed over, and that have no content.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption article section table tr tbody thead tfoot aside".split())
PASSED = frozenset("script style noscript head meta link".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr image".split())
#: Elements whose start closes an open element of the given kinds, up to the nearest of the limits.
CLOSES = {"li": ("li", ("ul", "ol")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",))}

NODE = "node int, parent int, last int, above array<int>, tag string, within string, attrs array<struct<name:string,value:string>>, text string"
LEAF = ["seq", "xpath", "tag", "text", "html", "anchors", "links", "hidden"]


class _Flat(HTMLParser):
    """A page's nodes as (parent, tag, attrs, text), in document order; all that is remembered is the stack of open ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple] = []
        self.open: list[int] = []

    def _close(self, tags: Iterable[str], limits: Iterable[str] = ()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]][1]
            if tag in limits:
                return
            if tag in tags:
                del self.open[k:]
                return

    def _add(self, tag: str | None, attrs: list, text: str | None) -> None:
        self.nodes.append((self.open[-1] if self.open else -1, tag, attrs, text))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close(("p",), BLOCKS - {"p"})
        if tag in CLOSES:
            kinds, limits = CLOSES[tag]
            for kind in kinds.split()[::-1]:
                self._close((kind,), limits)
        self._add(tag, list({k: v or "" for k, v in attrs}.items()), None)
        if tag not in EMPTY:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.open.pop()

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self._add(None, [], data)


def flat_nodes(source: str) -> Iterator[tuple]:
    """NODE rows of what is in the body; in a page without one, of all but the head.  Parents at the top are -1; ``above`` are a block's ancestors."""
    page = _Flat()
    page.feed(source)
    page.close()
    nodes = page.nodes
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, -1, -1):
        if (up := nodes[i][0]) >= 0:
            last[up] = max(last[up], last[i])
    top = next((i for i, n in enumerate(nodes) if n[1] == "body"), None)
    bare = top is None
    if bare:
        top = next((i for i, n in enumerate(nodes) if n[1] == "html" and n[0] < 0), -1)
    begin, end = (0, len(nodes)) if top < 0 else (top + 1, last[top] + 1)
    passed = -1
    for i in range(begin, end):
        parent, tag, attrs, text = nodes[i]
        if bare and tag == "head" and parent == top:
            passed = last[i]
        if i <= passed:
            continue
        above = None
        if tag in BLOCKS:
            above, up = [], parent
            while up != top:
                above.append(up)
                up = nodes[up][0]
        yield i, -1 if parent == top else parent, last[i], above, tag, None if parent == top else nodes[parent][1], [{"name": k, "value": v} for k, v in attrs], text


def node_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Written once: ``__page`` (a number of the page's own), keys and NODE; a null page has no nodes."""
    rows = pages.where(F.col(html).isNotNull()).select(F.monotonically_increasing_id().alias("__page"), *keys, F.col(html).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), NODE])
    names = ["__page", *keys, "node", "parent", "last", "above", "tag", "within", "attrs", "text"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = [(*own, *node) for *own, source in batch.iloc[at : at + 64].itertuples(index=False, name=None) for node in flat_nodes(source)]
                yield pd.DataFrame(out, columns=names)

    return staged(rows.mapInPandas(run, schema))


def attribute(attrs: Column, name: str) -> Column:
    """An element's attribute; null where it has none of the name."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def _holds(attrs: Column, names: list[str], word: str) -> Column:
    """Whether one of the attributes has the word in it, in lower case."""
    return F.exists(attrs, lambda a: a["name"].isin(names) & F.contains(F.lower(a["value"]), F.lit(word)))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def located(nodes: DataFrame) -> DataFrame:
    """nodes with ``segment`` (an element's step in a path), ``leaf``, ``owner`` (the leaf that a node is in or is), ``bottom`` (the same for blocks without any block in
    them), ``passed`` and ``hidden``.

    Rows that lie directly in a table without sections are in a ``tbody`` by their path, as browsers have it.
    """
    element, block = F.col("tag").isNotNull(), F.coalesce(F.col("tag").isin(*BLOCKS), F.lit(False))
    siblings = Window.partitionBy("__page", "parent")
    n = F.row_number().over(Window.partitionBy("__page", "parent", "tag").orderBy("node"))
    sections = F.max(F.coalesce(F.col("tag").isin("tbody", "thead", "tfoot"), F.lit(False))).over(siblings)
    loose = (F.col("tag") == "tr") & F.coalesce(F.col("within") == "table", F.lit(False)) & ~sections
    step = F.concat(F.when(loose, "/tbody[1]/").otherwise("/"), F.col("tag"), F.lit("["), n.cast("string"), F.lit("]"))
    rows = nodes.withColumn("block", block).withColumn("segment", F.when(element, step))
    parents = rows.where("block").select("__page", F.col("parent").alias("node")).distinct().withColumn("direct", F.lit(True))
    rows = rows.join(parents, ["__page", "node"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    page = Window.partitionBy("__page").orderBy("node")
    before, upto = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("__page").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda what, frame: F.coalesce(F.max(F.when(what, F.col("last"))).over(frame) >= F.col("node"), F.lit(False))
    rows = rows.withColumn("passed", inside(F.coalesce(F.col("tag").isin(*PASSED), F.lit(False)), upto))
    rows = rows.withColumn("deep", F.coalesce(F.last(F.when(F.col("block"), F.col("node")), ignorenulls=True).over(back) <= F.col("last"), F.lit(False)))
    rows = rows.withColumn("hidden", inside((F.col("tag") == "aside") & _holds(F.col("attrs"), ["epub:type"], "footnote"), upto))
    can = F.col("block") & ~F.col("direct") & ~F.col("passed")
    rows = rows.withColumn("leaf", can & ~inside(can, before))
    within = lambda what: F.last(F.when(what, F.struct("node", "last")), ignorenulls=True).over(upto)
    rows = rows.withColumn("o", within(F.col("leaf"))).withColumn("b", within(F.col("block") & ~F.col("deep")))
    of = lambda c: F.when(F.col(f"{c}.last") >= F.col("node"), F.col(f"{c}.node"))
    return rows.withColumn("owner", of("o")).withColumn("bottom", of("b")).drop("o", "b", "block", "direct", "deep")


def divided(rows: DataFrame) -> DataFrame:
    """rows with ``parts`` of the blocks without blocks that two or more line breaks divide, and without what was below them."""
    br, text = F.col("tag") == "br", F.col("text").isNotNull()
    shown = F.when(~F.col("passed") & (br | text), F.struct("node", F.when(br, "\u0000").otherwise(F.col("text")).alias("s")))
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]), "")
    cut = F.transform(F.split(flat, r"\u0000(?U:\s*)\u0000(?:(?U:\s*)\u0000)*"), lambda p: squeezed(F.replace(p, F.lit("\u0000"), F.lit(" "))))
    found = rows.where(F.col("bottom").isNotNull()).groupBy("__page", "bottom").agg(F.count_if(br).alias("breaks"), F.filter(cut, lambda p: p != "").alias("parts"))
    found = found.where((F.col("breaks") >= 2) & (F.size("parts") >= 2)).drop("breaks")
    whole = rows.join(found, ["__page", "bottom"], "left").where(F.col("parts").isNull() | (F.col("node") == F.col("bottom")))
    return whole.drop("bottom")


def _paths(rows: DataFrame) -> DataFrame:
    """__page, owner, xpath of every leaf: its ancestors' steps and its own."""
    steps = rows.where(F.col("segment").isNotNull()).select("__page", F.col("node").alias("up"), "segment")
    ups = rows.where("leaf").select("__page", F.col("node").alias("owner"), F.explode(F.concat("above", F.array("node"))).alias("up"))
    ordered = F.array_sort(F.collect_list(F.struct("up", "segment")))
    path = F.concat(F.lit("/body[1]"), F.array_join(F.transform(ordered, lambda s: s["segment"]), ""))
    return ups.join(steps, ["__page", "up"]).groupBy("__page", "owner").agg(path.alias("xpath"))


def _markup(own: Column, leaf: Column) -> Column:
    """The markup of a leaf's nodes but for the leaf itself; links that lead nowhere outside and name nothing are unwrapped."""
    value = lambda x, name: F.coalesce(attribute(x["attrs"], name), F.lit(""))
    bare = lambda x: (x["tag"] == "a") & (value(x, "id") == "") & (value(x, "name") == "") & ~value(x, "href").startswith("http")
    attrs = lambda x: F.array_join(F.transform(x["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), a["value"], F.lit('"'))), "")
    empty = lambda x: x["tag"].isin(*EMPTY)
    parts = lambda x: F.coalesce(F.array_join(F.transform(x["parts"], lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), ""), F.lit(""))
    opened = lambda x: F.when(x["tag"].isNull(), x["text"]).when(bare(x), "").otherwise(F.concat(F.lit("<"), x["tag"], attrs(x), F.when(empty(x), "/>").otherwise(">"), parts(x)))
    closed = lambda x: F.when(x["tag"].isNull() | bare(x) | empty(x), "").otherwise(F.concat(F.lit("</"), x["tag"], F.lit(">")))
    # An element closes after the last node below it, inner ones before outer ones.
    piece = lambda x: F.array(F.struct(x["node"].alias("at"), F.lit(0).alias("ends"), F.lit(0).alias("k"), opened(x).alias("s")), F.struct(x["last"].alias("at"), F.lit(1).alias("ends"), (-x["node"]).alias("k"), closed(x).alias("s")))
    pieces = F.array_sort(F.flatten(F.transform(F.filter(own, lambda x: x["node"] != leaf), piece)))
    return F.array_join(F.transform(pieces, lambda p: p["s"]), "")


def _contents(rows: DataFrame) -> DataFrame:
    """__page, owner, tag, hidden, text, html, links, parts of every leaf."""
    note = F.coalesce((F.col("tag") == "a") & _holds(F.col("attrs"), ["epub:type", "role"], "noteref"), F.lit(False))
    inner = Window.partitionBy("__page", "owner").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    noted = F.coalesce(F.max(F.when(note & ~F.col("leaf"), F.col("last"))).over(inner) >= F.col("node"), F.lit(False))
    held = rows.where(F.col("owner").isNotNull()).withColumn("noted", noted).withColumn("said", F.coalesce("text", F.array_join("parts", "")))
    whole = F.array_sort(F.collect_list(F.struct("node", "last", "tag", "attrs", "text", "said", "noted", "parts", note.alias("note"))))
    own = F.col("own")
    grouped = held.groupBy("__page", "owner").agg(whole.alias("own"), F.max(F.when(F.col("leaf"), F.struct("tag", "hidden"))).alias("of"), F.max(F.when(F.col("leaf"), F.col("parts"))).alias("parts"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), "")
    texts = F.filter(own, lambda x: x["said"].isNotNull())
    anchors = F.filter(own, lambda x: (x["tag"] == "a") & (F.coalesce(attribute(x["attrs"], "href"), F.lit("")) != ""))
    label = lambda a: F.regexp_replace(joined(F.filter(texts, lambda t: (t["node"] > a["node"]) & (t["node"] <= a["last"]))), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    links = F.transform(anchors, lambda a: F.struct(attribute(a["attrs"], "href").alias("href"), label(a).alias("label"), F.when(a["note"], "note").otherwise("link").alias("kind")))
    return grouped.select("__page", "owner", "of.tag", "of.hidden", squeezed(joined(F.filter(texts, lambda t: ~t["noted"]))).alias("text"), _markup(own, F.col("owner")).alias("html"), links.alias("links"), "parts")


def _anchored(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """__page, node, part, anchors of the leaves that are kept: the names in them, and those since the one before; names after the last are the last one's."""
    names = F.posexplode(F.array(attribute(F.col("attrs"), "id"), attribute(F.col("attrs"), "name"))).alias("k", "name")
    of = rows.where(F.col("tag").isNotNull() & (F.col("owner").isNotNull() | ~F.col("passed"))).select("__page", F.col("node").alias("i"), "owner", names).where(F.coalesce("name", F.lit("")) != "")
    spot = of.select("__page", F.coalesce("owner", "i").alias("node"), F.lit(-1).alias("part"), F.lit(False).alias("is_leaf"), "i", "k", "name")
    both = spot.unionByName(kept.select("__page", "node", "part", F.lit(True).alias("is_leaf")), allowMissingColumns=True)
    ahead = Window.partitionBy("__page").orderBy(F.desc("node"), F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("is_leaf"), F.struct("node", "part"))
    to = F.coalesce(F.last(key, ignorenulls=True).over(ahead), F.max(key).over(Window.partitionBy("__page")))
    told = both.withColumn("to", to).where(~F.col("is_leaf") & F.col("to").isNotNull())
    return told.groupBy("__page", F.col("to.node").alias("node"), F.col("to.part").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", "name"))), lambda a: a["name"]).alias("anchors"))


def leaf_blocks(pages: DataFrame, keys: list[str], html: str, least: int = 2) -> DataFrame:
    """keys, the columns of LEAF and ``order_index``: the leaf blocks of each page whose text has ``least`` characters or more.

    A leaf is a block that holds no block directly; text that lies between blocks is no block's and is left out.  A block without any block in it whose text two or more
    line breaks divide is that many paragraphs; single breaks are spaces there.  Labels of links to notes are no text.  Null html has no blocks.  A page's nodes are dealt
    by the page, so what a task holds is a page.
    """
    rows = staged(divided(located(node_rows(pages, keys, html))))
    found = staged(_contents(rows).join(_paths(rows), ["__page", "owner"]))
    one = found.where(F.col("parts").isNull()).select("__page", F.col("owner").alias("node"), F.lit(0).alias("part"), "xpath", "tag", "text", "html", "links", "hidden")
    many = found.where(F.col("parts").isNotNull()).select("__page", F.col("owner").alias("node"), F.posexplode("parts").alias("part", "text"), "xpath", "hidden")
    many = many.select(
        "__page", "node", "part", F.concat("xpath", F.lit("/p["), (F.col("part") + 1).cast("string"), F.lit("]")).alias("xpath"), F.lit("p").alias("tag"), "text", F.col("text").alias("html"),
        F.array().cast(found.schema["links"].dataType).alias("links"), "hidden",
    )
    order = Window.partitionBy("__page").orderBy("node", "part")
    leaves = one.unionByName(many).withColumn("seq", F.row_number().over(order) - 1)
    kept = leaves.where(F.length("text") >= least).withColumn("order_index", F.row_number().over(order) - 1)
    anchors = _anchored(rows, kept)
    named = rows.groupBy("__page").agg(*[F.first(k).alias(k) for k in keys])
    whole = kept.join(anchors, ["__page", "node", "part"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>"))).join(named, "__page")
    return whole.select(*keys, *LEAF, "order_index")


def plain(text: str) -> str:
    """Text with its entities decoded."""
    return entities.unescape(text)
