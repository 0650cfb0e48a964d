"""E-books: ZIP files to one row for each file of their reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPINE = "book string, title string, author string, language string, spine_index int, file string, linear boolean, toc_title string, guide_role string, html string"
# Types of guide references and the names of their roles.
GUIDE = {
    "cover": "Cover", "title-page": "Title Page", "titlepage": "Title Page", "copyright-page": "Copyright", "copyright": "Copyright", "dedication": "Dedication",
    "acknowledgements": "Acknowledgments", "acknowledgments": "Acknowledgments", "epigraph": "Epigraph", "foreword": "Foreword", "preface": "Preface", "prologue": "Prologue",
    "epilogue": "Epilogue", "afterword": "Afterword", "glossary": "Glossary", "bibliography": "Bibliography", "index": "Index", "colophon": "Colophon", "toc": "Contents",
}


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [n for n in node.iter() if _local(n) == name]


def _member(book: zipfile.ZipFile, name: str) -> bytes | None:
    """A file of a book; None if it is damaged."""
    try:
        return book.read(name)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return None


def _toc(book: zipfile.ZipFile, items: dict[str, dict], base: str) -> dict[str, str]:
    """File to title, the first entry of a file; the navigation document goes before the NCX."""
    found: dict[str, str] = {}
    nav = next((i for i in items.values() if "nav" in i.get("properties", "").split()), None)
    ncx = next((i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml" or i.get("href", "").endswith(".ncx")), None)
    for item, read in ((nav, _nav_entries), (ncx, _ncx_entries)):
        if item is None or found:
            continue
        path = posixpath.normpath(posixpath.join(base, unquote(item["href"])))
        if path in book.namelist():
            for href, title in read((_member(book, path) or b"").decode("utf-8", "replace")):
                file = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(href.split("#")[0])))
                if title:
                    found.setdefault(file, title)
    return found


def _nav_entries(source: str) -> list[tuple[str, str]]:
    """Links of the table of contents: of the first list marked as one, else of the first list of links, else of the page."""
    from quire.sources.html import flat_nodes

    nodes = [(i, last, tag, {a["name"]: a["value"] for a in attrs}, text) for i, _, last, _, tag, _, attrs, text in flat_nodes(source)]
    navs = [n for n in nodes if n[2] == "nav"]
    begin, end = next(((n[0], n[1]) for n in navs if n[3].get("epub:type") == "toc"), (navs[0][0], navs[0][1]) if navs else (-1, len(source)))
    label = lambda a: " ".join("".join(n[4] for n in nodes if n[4] is not None and a[0] < n[0] <= a[1]).split())
    return [(n[3]["href"], label(n)) for n in nodes if n[2] == "a" and n[3].get("href") and begin < n[0] <= end]


def _ncx_entries(source: str) -> list[tuple[str, str]]:
    """Entries of an NCX; a broken one has none."""
    out = []
    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError:
        return out
    for point in _all(root, "navPoint"):
        label, content = _all(point, "text"), [c for c in point if _local(c) == "content"]
        if label and content:
            out.append((content[0].get("src", ""), " ".join((label[0].text or "").split())))
    return out


def spine_rows(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of SPINE of one book; a book that is no ZIP file or names no package has none.  A damaged file has a row without html, a damaged table of contents no titles."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = _all(container, "rootfile")[0].get("full-path", "")
        opf = ElementTree.fromstring(book.read(package))
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, KeyError, IndexError, ElementTree.ParseError):
        return
    base = posixpath.dirname(package)
    first = lambda tag: next((" ".join((n.text or "").split()) for n in _all(opf, tag)), None)
    items = {i.get("id", ""): dict(i.attrib) for i in _all(opf, "item")}
    toc = _toc(book, items, base)
    guide = {posixpath.normpath(posixpath.join(base, unquote(r.get("href", "").split("#")[0]))): GUIDE.get(r.get("type", "").lower()) for r in _all(opf, "reference")}
    n, spine = 0, [(items.get(r.get("idref", "")), r.get("linear") != "no") for r in _all(opf, "itemref")]
    if not any(item for item, _ in spine):  # no reading order: pages by the last number of their names
        pages = [i for i in items.values() if "html" in i.get("media-type", "")]
        number = lambda i: [int(x) for x in re.findall(r"\d+", posixpath.basename(i.get("href", "")))[-1:]] or [1 << 60]
        spine = [(i, True) for i in sorted(pages, key=lambda i: (number(i), i.get("href", "")))]
    for item, linear in spine:
        if item is None:
            continue
        file = posixpath.normpath(posixpath.join(base, unquote(item.get("href", ""))))
        if file in book.namelist():
            source = _member(book, file)
            yield (name, first("title"), first("creator"), first("language"), n, file, linear, toc.get(file), guide.get(file), None if source is None else source.decode("utf-8", "replace"))
            n += 1


def formats(spark: SparkSession, path: str) -> DataFrame:
    """path, format (the ending of the name) and ``supported`` of the files that a path or pattern names, so that books of other formats are seen to be left out."""
    files = spark.read.format("binaryFile").load(path).select("path")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", ending.alias("format"), (ending == "epub").alias("supported"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SPINE of the e-books that a path or pattern names: ZIP packages; other formats have no rows (``formats`` tells them)."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".epub")).select("path", "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPINE.split(", ")]
        for batch in batches:
            for path_, content in batch.itertuples(index=False, name=None):
                yield pd.DataFrame(list(spine_rows(re.sub(r".*/", "", path_), content)), columns=names)

    return files.mapInPandas(run, SPINE)
