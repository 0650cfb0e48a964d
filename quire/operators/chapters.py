"""Files of a book to titled chapters, links and notes: windows and joins over spine and block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_heading_like, matter_role, zip_path

#: Pages with fewer characters are tiny; files with as many go on with the chapter before them.
TINY, SUBSTANTIAL = 300, 1500
#: Headings derived from blocks: how many blocks, of how many characters at most.
HEADINGS, HEADING_CHARS = 3, 50
#: What the heading of a page of notes holds.
NOTES = ["notes", "endnotes", "footnotes", "references", "注释", "註釋"]
#: Labels of notes: a number of up to four digits or one mark, in brackets or not.
NOTE_LABEL = r"^[\[(]?(\d{1,4}|[*†‡§‖¶#])[\])]?\.?$"


def file_facts(spine: DataFrame, blocks: DataFrame) -> DataFrame:
    """spine with text_length, has_images, own_h1, heading and derived of each file; files without a block are left out, as are those out of the reading order."""
    facts = blocks.groupBy("book", "spine_index").agg(
        F.sum(F.length("text")).alias("text_length"),
        F.min_by("text", F.when(F.col("tag") == "h1", F.col("seq"))).alias("own_h1"),
        F.coalesce(*[F.min_by("text", F.when(F.col("tag") == h, F.col("seq"))) for h in ("h1", "h2", "h3")]).alias("heading"),
        F.array_sort(F.collect_list(F.when(F.col("seq") < 2 * HEADINGS, F.struct("seq", "text")))).alias("opening"),
    )
    # The leading blocks that read like headings, up to the first that does not.
    texts = F.transform("opening", lambda b: b["text"])
    fits = lambda t: (F.length(t) <= HEADING_CHARS) & is_heading_like(t)
    leading = F.aggregate(texts, F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("over")), lambda s, t: F.struct(
        F.when(s["over"] | ~fits(t) | (F.size(s["out"]) >= HEADINGS), s["out"]).otherwise(F.array_append(s["out"], t)).alias("out"), (s["over"] | ~fits(t)).alias("over")))
    facts = facts.withColumn("derived", F.array_join(leading["out"], " – ")).drop("opening")
    images = F.col("html").rlike(r"(?i)<(img|image)[\s/>]")
    return spine.where("linear").withColumn("has_images", images).join(facts, ["book", "spine_index"])


def titled(files: DataFrame) -> DataFrame:
    """files that become chapters, with ``chapter`` and ``title``.

    A tiny page that the table of contents names gives its title to a following file without one, and goes; after the first entry, substantial files without one
    begin a chapter with their own h1 or go on with the last title; tiny pages outside the entries' range go; others are named by heading, guide, file name or opening.
    """
    book = Window.partitionBy("book")
    order = book.orderBy("spine_index")
    covered = F.when(F.col("toc_title").isNotNull(), F.col("spine_index"))
    rows = files.withColumn("usable", F.count(covered).over(book) >= 2).withColumn("first", F.min(covered).over(book)).withColumn("last", F.max(covered).over(book))
    tiny = (F.col("text_length") < TINY) & ~F.col("has_images")
    gives = F.col("usable") & F.col("toc_title").isNotNull() & tiny & F.lead("spine_index").over(order).isNotNull() & F.lead("toc_title").over(order).isNull()
    rows = rows.withColumn("gives", gives)
    rows = rows.withColumn("donated", F.when(F.lag("gives").over(order), F.lag("toc_title").over(order))).where(~F.col("gives"))
    later = F.col("usable") & (F.col("spine_index") > F.col("first")) & (F.col("text_length") >= SUBSTANTIAL)
    setter = F.coalesce("donated", "toc_title", F.when(later, F.nullif("own_h1", F.lit(""))))
    rows = rows.withColumn("last_title", F.last(setter, ignorenulls=True).over(order)).withColumn("set_title", setter)
    outside = F.col("usable") & ((F.col("spine_index") < F.col("first")) | (F.col("spine_index") > F.col("last"))) & tiny
    inherits = later & F.col("last_title").isNotNull()
    rows = rows.where(F.col("set_title").isNotNull() | inherits | ~outside)
    named = F.coalesce("set_title", F.when(inherits, F.col("last_title")), F.nullif("heading", F.lit("")), "guide_role", F.nullif(matter_role(F.col("file")), F.lit("")), F.nullif("derived", F.lit("")))
    rows = rows.withColumn("chapter", F.row_number().over(order))
    return rows.select("book", "chapter", F.coalesce(named, F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))).alias("title"), "file", "spine_index", "text_length")


def links(blocks: DataFrame) -> DataFrame:
    """One row for each link of a block: its target file (empty for the own one), fragment, label and kind."""
    rows = blocks.select("book", "file", "xpath", "seq", F.explode("links").alias("link")).where(~F.col("link.href").rlike("(?i)^[a-z][a-z0-9+.-]*:"))
    path, fragment = F.regexp_extract("link.href", "^([^#]*)", 1), F.regexp_extract("link.href", "#(.*)$", 1)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    folder = F.regexp_extract("file", "^(.*/)[^/]*$", 1)
    target = F.when(path == "", F.col("file")).when(path.startswith("/"), zip_path(path)).otherwise(zip_path(F.concat(folder, path)))
    return rows.select("book", "file", "xpath", "seq", target.alias("target_file"), F.nullif(fragment, F.lit("")).alias("fragment"), "link.label", "link.kind")


def resolved(link_rows: DataFrame, blocks: DataFrame, chapters: DataFrame, notes_files: DataFrame) -> DataFrame:
    """Links with the chapter and xpath that they lead to: the fragment's block, else the file's first; others are left out.  ``is_note`` by markup, notes page or label echo."""
    of = chapters.select("book", F.col("file").alias("target_file"), F.col("chapter").alias("target_chapter"))
    rows = link_rows.join(of, ["book", "target_file"])
    anchors = blocks.select("book", F.col("file").alias("target_file"), F.explode("anchors").alias("fragment"), "seq", "xpath", "text")
    exact = anchors.groupBy("book", "target_file", "fragment").agg(F.min_by(F.struct(F.col("xpath").alias("xpath"), F.col("text").alias("text")), "seq").alias("exact"))
    first = blocks.groupBy("book", F.col("file").alias("target_file")).agg(F.min_by(F.struct(F.col("xpath").alias("xpath"), F.col("text").alias("text")), "seq").alias("first"))
    rows = rows.join(exact, ["book", "target_file", "fragment"], "left").join(first, ["book", "target_file"])
    notes = notes_files.select("book", F.col("file").alias("target_file"), F.lit(True).alias("to_notes"))
    rows = rows.join(notes, ["book", "target_file"], "left").withColumn("to", F.coalesce("exact", "first"))
    core = F.regexp_replace("label", r"[\[\]().]", "")
    after = F.regexp_replace(F.concat("to.text", F.lit(" ")), r"^[\[(]", "")
    echo = (core != "") & after.startswith(core) & F.substring(after, F.length(core) + 1, F.lit(2)).rlike(r"^[\])]?[.):\s]")
    labelled = F.col("label").rlike(NOTE_LABEL)
    is_note = (F.col("kind") == "note") | (labelled & F.when((F.col("target_file") != F.col("file")) & F.col("to_notes"), True).otherwise(echo))
    return rows.select("book", "file", "xpath", "label", "target_chapter", F.col("to.xpath").alias("target_xpath"), is_note.alias("is_note"))


def notes_pages(blocks: DataFrame, chapters: DataFrame, least: float = 0.25, alone: float = 0.5) -> DataFrame:
    """chapters with ``ratio``, the share of paragraphs whose first link leads to another file, and ``is_notes``."""
    p = blocks.where((F.col("tag") == "p") & (F.length("text") >= 3))
    target = F.regexp_extract(F.try_element_at("links", F.lit(1))["href"], "^([^#]*)", 1)
    back = F.coalesce((target != "") & ~target.startswith("http") & ~target.endswith(F.element_at(F.split("file", "/"), -1)), F.lit(False))
    sums = p.groupBy("book", "file").agg(F.count("*").alias("total"), F.sum(back.cast("int")).alias("back"))
    short = lambda c: (F.length(c) < 30) & _any(F.lower(c))
    heads = blocks.where(F.col("tag").isin("h1", "h2", "h3", "p") & (F.col("seq") < 3)).groupBy("book", "file").agg(F.max(short(F.col("text")).cast("int")).alias("headed"))
    rows = chapters.join(sums, ["book", "file"], "left").join(heads, ["book", "file"], "left")
    ratio = F.coalesce(F.col("back") / F.col("total"), F.lit(0.0))
    headed = (F.coalesce("headed", F.lit(0)) == 1) | (F.coalesce(short(F.col("title")), F.lit(False)))
    total = F.coalesce("total", F.lit(0))
    return rows.select(*chapters.columns, ratio.alias("ratio"), ((headed & (total >= 3) & (ratio >= least)) | ((total >= 5) & (ratio >= alone))).alias("is_notes"))


def _any(text: Column) -> Column:
    out = F.lit(False)
    for word in NOTES:
        out = out | F.contains(text, F.lit(word))
    return out


def note_entries(blocks: DataFrame) -> DataFrame:
    """Entries of notes pages: a block that opens with a label begins one, blocks without go on with it; ``section`` is the last heading before."""
    order = Window.partitionBy("book", "file").orderBy("seq")
    label = F.nullif(F.regexp_extract("text", r"^[\[(]?(\d{1,4}|[*†‡§‖¶#])[\])]?[.):\s]", 1), F.lit(""))
    heading = F.col("tag").rlike("^h[1-6]$")
    rows = blocks.withColumn("label", F.when(~heading, label)).withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(order))
    rows = rows.withColumn("entry", F.sum(F.when(F.col("label").isNotNull() | heading, 1).otherwise(0)).over(order)).where(~heading)
    parts = rows.groupBy("book", "file", "entry").agg(F.max("label").alias("label"), F.max("section").alias("section"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return parts.where(F.col("label").isNotNull()).select("book", "file", "entry", "label", "section", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


def compatible(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """For each book: chapters stored and parsed, stored paths that the parse no longer has, and whether both agree."""
    keys = ["book", "chapter", "xpath"]
    gone = stored.join(parsed.select(*keys), keys, "left_anti").groupBy("book").agg(F.count("*").alias("missing"))
    n = lambda rows, name: rows.groupBy("book").agg(F.countDistinct("chapter").alias(name))
    rows = n(stored, "stored").join(n(parsed, "parsed"), "book", "full").join(gone, "book", "left")
    rows = rows.select("book", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("parsed", F.lit(0)).alias("parsed"), F.coalesce("missing", F.lit(0)).alias("missing"))
    return rows.withColumn("agree", (F.col("stored") == F.col("parsed")) & (F.col("missing") == 0))


def image_files(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of images with the stored file they mean: the exact path, else without leading ``../``, else by file name."""
    keys = images.select(F.col("path").alias("image_path"), "stored")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = keys.groupBy(base(F.col("image_path")).alias("name")).agg(F.min("stored").alias("by_name"))
    bare = F.regexp_replace("src", r"^(?:\.\./)+", "")
    rows = sources.join(keys.select(F.col("image_path").alias("p1"), F.col("stored").alias("by_path")), F.col("src") == F.col("p1"), "left")
    rows = rows.join(keys.select(F.col("image_path").alias("p2"), F.col("stored").alias("by_bare")), bare == F.col("p2"), "left").join(named, base(F.col("src")) == F.col("name"), "left")
    return rows.select(*sources.columns, F.coalesce("by_path", "by_bare", "by_name").alias("stored"))


def note_refs(anchors: DataFrame, notes_files: DataFrame) -> DataFrame:
    """anchors (book, file, href, label, id, parent_id) that lead to a page of notes and have a number: target file and anchor, the number, and where they come from.

    A page of notes is told by its name, by a name that ends in the link's path, or by the link's path ending in its base name; a link without a path is to its own file.
    """
    known = notes_files.groupBy(F.col("book").alias("of")).agg(F.collect_set("file").alias("known"))
    path = F.regexp_extract("href", "^([^#]*)", 1)
    anchor, target = F.regexp_extract("href", "#([^#]*)", 1), F.when(path == "", F.col("file")).otherwise(path)
    rows = anchors.where(F.col("href") != "").join(known, F.col("book") == F.col("of")).withColumns({"path": path, "anchor": anchor, "target": target})
    to_notes = F.exists("known", lambda f: (f == F.col("target")) | f.endswith(F.col("path")) | F.col("path").endswith(F.regexp_extract(f, "([^/]*)$", 1)))
    number = F.nullif(F.regexp_extract("label", r"(\d+)", 1), F.lit(""))
    source = F.coalesce(F.nullif("id", F.lit("")), F.nullif("parent_id", F.lit("")))
    return rows.where(to_notes & number.isNotNull()).select("book", "file", source.alias("source_anchor"), F.col("target").alias("target_file"), F.col("anchor").alias("target_anchor"), number.alias("number"))
