"""A second reading of pages, by a tree and page by page, that the rows of ``quire.sources.html`` are held against."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

# Elements that hold paragraphs, that are passed over, and that have no content.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption article section table tr tbody thead tfoot aside".split())
PASSED = frozenset("script style noscript head meta link".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr image".split())
#: Elements whose start closes an open element of the given kinds, up to the nearest of the limits.
CLOSES = {"li": ("li", ("ul", "ol")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",))}

LEAF = "seq int, xpath string, tag string, text string, html string, anchors array<string>, links array<struct<href:string,label:string,kind:string>>, hidden boolean"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip=lambda node: False) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or not skip(x):
                stack += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: Iterable[str], limits: Iterable[str] = ()) -> None:
        node = self.at
        while node.parent is not None and node.tag not in limits:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close(("p",), BLOCKS - {"p"})
        if tag in CLOSES:
            kinds, limits = CLOSES[tag]
            for kind in kinds.split()[::-1]:
                self._close((kind,), limits)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in EMPTY:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self.at.children.append(data)


def body_of(source: str) -> Node:
    """The body element, or an element of that name around everything but the head."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    for node in builder.root.walk():
        if node.tag == "body":
            return node
    body = Node("body", {}, None)
    top = next((n for n in builder.root.elements() if n.tag == "html"), builder.root)
    body.children = [c for c in top.children if not (isinstance(c, Node) and c.tag == "head")]
    for c in body.elements():
        c.parent = body
    return body


def wrap_rows(body: Node) -> None:
    """Rows that lie directly in a table without sections go into one ``tbody``, as browsers have it."""
    for table in [n for n in body.walk() if n.tag == "table"]:
        rows = [c for c in table.elements() if c.tag == "tr"]
        if rows and not any(c.tag in ("tbody", "thead", "tfoot") for c in table.elements()):
            section = Node("tbody", {}, table)
            section.children = rows
            for r in rows:
                r.parent = section
            table.children = [c for c in table.children if c not in rows] + [section]


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _holding(body: Node) -> set[int]:
    """The elements (by ``id``) that hold a block at any depth."""
    out: set[int] = set()
    for node in body.walk():
        if node.tag in BLOCKS:
            up = node.parent
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return out


def split_breaks(body: Node) -> None:
    """A block without blocks in it whose text two or more line breaks divide becomes that many paragraphs; single ones are spaces."""
    holding = _holding(body)
    for block in [n for n in body.walk() if n.tag in BLOCKS and id(n) not in holding]:
        if sum(n.tag == "br" for n in block.walk()) < 2:
            continue
        flat = "".join("\x00" if isinstance(x, Node) else x for x in _flat(block))
        parts = [_squeezed(p.replace("\x00", " ")) for p in re.split(r"\x00\s*\x00(?:\s*\x00)*", flat)]
        parts = [p for p in parts if p]
        if len(parts) >= 2:
            block.children = []
            for part in parts:
                child = Node("p", {}, block)
                child.children = [part]
                block.children.append(child)


def _flat(node: Node) -> Iterator[Node | str]:
    """Texts and line breaks below a node, in order."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.tag == "br":
            yield x
        elif x.tag not in PASSED:
            stack += reversed(x.children)


def serialised(node: Node | str) -> str:
    """Markup of a node; links that lead nowhere outside and name nothing are unwrapped."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "a" and not (x.attrs.get("id") or x.attrs.get("name") or x.attrs.get("href", "").startswith("http")):
            stack += reversed(x.children)
        else:
            attrs = "".join(f' {k}="{v}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}/>" if x.tag in EMPTY else f"<{x.tag}{attrs}>")
            if x.tag not in EMPTY:
                stack += [f"</{x.tag}>", *reversed(x.children)]
    return "".join(out)


def _kind(link: Node) -> str:
    marks = f"{link.attrs.get('epub:type', '')} {link.attrs.get('role', '')}".lower()
    return "note" if "noteref" in marks else "link"


def _names(node: Node) -> list[str]:
    return [v for v in (node.attrs.get("id"), node.attrs.get("name")) if v]


def long_enough(rows: Iterable[tuple], least: int) -> list[tuple]:
    """The rows of LEAF whose text has ``least`` characters or more; anchors of the others go to the next of them, or the last."""
    kept, waiting = [], []
    for row in rows:
        if len(row[3]) < least:
            waiting += row[5]
            continue
        row[5][:0] = waiting
        waiting = []
        kept.append(row)
    if kept:
        kept[-1][5].extend(waiting)
    return kept


def leaves(body: Node) -> Iterator[tuple]:
    """Rows of LEAF: blocks that hold no block directly, in document order, with their path.  Text that lies between blocks is no block's and is left out.

    Anchors outside such blocks are the next one's; those after the last are the last one's.
    """
    seq, path, hidden, row, waiting = 0, ["/body[1]"], 0, None, []

    def below(node: Node) -> Iterator[tuple[Node, int]]:
        seen: dict[str, int] = {}
        for child in node.elements():
            seen[child.tag] = seen.get(child.tag, 0) + 1
            if child.tag not in PASSED:
                yield child, seen[child.tag]

    # Open elements: what is left of their children, and whether their end ends a hidden aside.
    open_ = [(below(body), False)]
    while open_:
        rest, aside = open_[-1]
        if (found := next(rest, None)) is None:
            open_.pop()
            path.pop()
            hidden -= aside
            continue
        child, n = found
        own, aside = f"/{child.tag}[{n}]", child.tag == "aside" and "footnote" in child.attrs.get("epub:type", "")
        if child.tag in BLOCKS and not any(c.tag in BLOCKS for c in child.elements()):
            links = [(a.attrs["href"], a.text().strip(), _kind(a)) for a in child.walk() if a.tag == "a" and a.attrs.get("href")]
            if row is not None:
                yield row
            anchors, waiting = waiting + [v for n in child.walk() for v in _names(n)], []
            text = _squeezed(child.text(lambda n: n.tag == "a" and _kind(n) == "note"))
            row = (seq, "".join(path) + own, child.tag, text, "".join(map(serialised, child.children)), anchors, links, bool(hidden or aside))
            seq += 1
        else:
            waiting += _names(child)
            path.append(own)
            hidden += aside
            open_.append((below(child), aside))
    if row is not None:
        row[5].extend(waiting)
        yield row
