"""Cleaning of catalogue titles, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

# Words that mark the right-hand part of a title as advertising.
MARKETING = (
    "推荐|出品|新著|畅销|获奖|纪念版|珍藏版|修订版|完整版|完整传记|全译本|出版社|译丛|丛书|edition|kindle|illustrated|anniversary|complete|with a new|foreword|introduction|"
    r"bestseller|award|winner|series|book\s+\d+|volume|vol\.|a novel|a memoir"
)
# Pairs of marks around a title, and of brackets at its end.
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")]
BRACKETS = [("（", "）"), ("(", ")"), ("[", "]"), ("【", "】")]
# Ends of a title that name its edition.
EDITIONS = [
    r"(?:[。.!?]\s*)?第[一二三四五六七八九十0-9]+版[^。.!?]*[。.!?]?$",
    r"(?i)(?:[.;]\s*)?(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|new|revised)\s+edition(?![A-Za-z0-9_]).*$",
]
#: Passes that are made on every title; only a title that still changes then is gone over until it does not.
PASSES = 2
SPACE = r"[\s\x{3000}\x{00A0}]"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def settled(text: Column, once: Callable[[Column], Column]) -> Column:
    """``once`` until nothing changes; a pass that changes something takes away two characters at least, so half the length in passes is enough."""
    for _ in range(PASSES):
        text = once(text)
    whole = lambda t: F.aggregate(F.sequence(F.lit(0), F.floor(F.length(t) / 2).cast("int")), t, lambda out, _: once(out))
    return let(text, lambda t: F.when(once(t) == t, t).otherwise(whole(t)))


def spaced(title: Column) -> Column:
    """White space collapsed, none before closing or after opening punctuation."""
    out = F.regexp_replace(title, f"{SPACE}+", " ")
    out = F.regexp_replace(out, r" ([：:，,。.!?？；;）)\]】》])", "$1")
    return _trim(F.regexp_replace(out, r"([（(\[【《]) ", "$1"))


def without_quotes(title: Column) -> Column:
    def once(out: Column) -> Column:
        for left, right in QUOTES:
            out = F.regexp_replace(out, f"(?s)^{left}(?=.{{2}}){SPACE}*(.*?){SPACE}*{right}$", "$1")
        return out

    return settled(_trim(title), once)


def unwrapped(title: Column) -> Column:
    """《Name》 becomes Name; 《Name》: rest becomes Name：rest."""
    name = _trim(F.regexp_extract(title, "^《([^》]+)》", 1))
    rest = _trim(F.regexp_replace(title, f"^《[^》]+》{SPACE}*[:：]?", ""))
    return F.when(~title.rlike("^《[^》]+》"), title).when(rest == "", name).when(rest.rlike("^[／/]"), F.concat_ws(" ", name, rest)).otherwise(F.concat(name, F.lit("："), rest))


def without_brackets(title: Column) -> Column:
    """Bracketed descriptors at the end go, as long as something stands before them."""
    def once(out: Column) -> Column:
        for left, right in BRACKETS:
            a, b = (f"\\{c}" if c in "()[]" else c for c in (left, right))
            # Text without brackets, or with nested pairs of one level.
            inner = f"[^{a}{b}]*(?:{a}[^{a}{b}]*{b}[^{a}{b}]*)*"
            out = F.regexp_replace(out, rf"(?s)^(.*\S){SPACE}*{a}{inner}{b}$", "$1")
        return out

    return settled(_trim(title), once)


def without_marketing(title: Column) -> Column:
    def at_mark(mark: str):
        def body(out: Column) -> Column:
            at = F.instr(out, F.lit(mark))
            left, right = _trim(F.substring(out, F.lit(1), at - 1)), _trim(F.substring(out, at + len(mark), F.length(out)))
            return F.when((at > 1) & (left != "") & (right.rlike(f"(?i){MARKETING}") | (F.length(out) > 80)), left).otherwise(out)

        return body

    def at_dash(out: Column) -> Column:
        dash = r"^(.+?)(?:\s+[-–—]\s+|——)(.+)$"
        left, right = _trim(F.regexp_extract(out, dash, 1)), _trim(F.regexp_extract(out, dash, 2))
        return F.when((left != "") & right.rlike(f"(?i){MARKETING}"), left).otherwise(out)

    return let(let(let(_trim(title), at_mark(" | ")), at_mark("｜")), at_dash)


def without_edition(title: Column) -> Column:
    for end in EDITIONS:
        title = F.regexp_replace(title, end, "")
    return _trim(title)


def clean_title(title: Column) -> Column:
    """All of the above in order; what would be empty stays as it was."""

    def body(first: Column) -> Column:
        out = without_edition(let(without_brackets(let(without_quotes(first), unwrapped)), without_marketing))
        return let(without_quotes(spaced(out)), lambda x: F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(first))

    return let(spaced(title), body)


def spine_title(title: Column) -> Column:
    """The part before the subtitle, shortened for a narrow spine."""

    def main_part(whole: Column) -> Column:
        parts = []
        for mark in ("：", ":", " / ", "／"):
            at = F.instr(whole, F.lit(mark))
            left, right = without_quotes(F.substring(whole, F.lit(1), at - 1)), _trim(F.substring(whole, at + len(mark), F.length(whole)))
            parts.append(F.when((at > 1) & (left != "") & (F.length(right) >= 2), left))
        return F.coalesce(*parts, whole)

    def before_comma(out: Column) -> Column:
        left = F.regexp_extract(out, r"(?i)^([^,]{4,36}),\s+(?:from|to|with|being|including|containing|or)(?![A-Za-z0-9_])", 1)
        return F.when(left != "", _trim(left)).otherwise(out)

    def elements(out: Column) -> Column:
        of = F.regexp_extract(out, r"(?i)^(?:the\s+)?elements\s+of\s+(.+)$", 1)
        return F.when((of != "") & (F.length(out) > 28), _trim(of)).otherwise(out)

    def body(whole: Column) -> Column:
        out = without_quotes(spaced(let(let(main_part(whole), before_comma), elements)))
        return let(out, lambda x: F.when(x != "", x).otherwise(whole))

    return let(spaced(title), body)


def usable_title(original: Column, fallback: Column, candidate: Column, most: int = 120) -> Column:
    """Whether a proposed title may replace the fallback: not longer, no lost subtitle, no change of script."""
    clean = spaced(candidate)
    marks = ["：", ":", "/", "／"]
    has = lambda x: F.coalesce(x.rlike("[" + "".join(marks) + "]"), F.lit(False))
    lost = F.lit(False)
    for mark in ("：", ":", " / ", "/", "／"):
        at = F.instr(fallback, F.lit(mark))
        left, right = _trim(F.substring(fallback, F.lit(1), at - 1)), _trim(F.substring(fallback, at + len(mark), F.length(fallback)))
        lost = lost | ((at > 1) & (left != "") & (F.length(right) >= 2) & ~has(clean) & (F.length(clean) < F.length(fallback)))
    latin = lambda x: F.regexp_count(x, F.lit("[A-Za-z]"))
    cjk = lambda x: x.rlike("[㐀-鿿]")
    return (clean != "") & (F.length(clean) <= most) & (F.length(clean) <= F.length(original) + 10) & ~lost & ~((latin(original) >= 3) & (latin(clean) == 0)) & ~(cjk(original) & ~cjk(clean))
