"""Untranslated English left in a text, and glossaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import CJK, count_of, let, squeeze_cjk, strip_hosts, strip_quoted, strip_urls

#: Words that are let through, as technical terms or because they are too common to tell.
LET_THROUGH = [
    "the", "and", "for", "with", "from", "that", "this", "not", "but", "are", "was", "were", "has", "had", "have", "will", "can", "may", "app", "web", "api", "url", "http",
    "https", "www", "html", "css", "pdf", "jpg", "png", "gif", "xml", "json", "sql", "seg", "translate", "context",
]
#: Shapes of words that are English inflections beyond doubt.
SHAPES = ["^[a-z]{3,}ly$", "^[a-z]{2,}(?:tion|sion|ment|ness|able|ible|ive|ous|ful|less|ical|istic)$", "^[a-z]{4,}(?:ing|ed|al)$"]
SHAPE = "|".join(SHAPES)
#: Share of CJK letters from which on a text counts as translated but for single words.
MOSTLY = 0.6


def mostly(cjk: Column, latin: Column, least: float) -> Column:
    return (cjk > 0) & (cjk / (cjk + latin) >= least)


def is_mostly_cjk(text: Column, least: float = MOSTLY) -> Column:
    return mostly(count_of(text, CJK), count_of(text, "a-zA-Z"), least)


def allowed_words(glossary: Column) -> Column:
    """Lower-cased words of a glossary map that may stay: of terms those of 3 characters or more, of translations those of Latin letters."""
    words = lambda xs, fit: F.flatten(F.transform(xs, lambda x: F.filter(F.split(x, r"\s+"), fit)))
    terms = words(F.map_keys(glossary), lambda w: F.length(w) >= 3)
    values = words(F.map_values(glossary), lambda w: w.rlike("^[a-zA-Z]{3,}$"))
    return F.array_distinct(F.transform(F.concat(terms, values), F.lower))


def residue(text: Column, common_words: list[str], allowed: Column | None = None) -> Column:
    """English words left in a text, in their order, with repeats.

    ``common_words`` is the list of words that never belong in a mostly CJK text; ``allowed`` an array of words to let through.
    """
    none = F.array().cast("array<string>")
    tokens = lambda x: F.regexp_extract_all(x, F.lit("([a-zA-Z]{3,})"), F.lit(1))
    known = lambda w: w.isin(LET_THROUGH) if allowed is None else w.isin(LET_THROUGH) | F.array_contains(F.coalesce(allowed, none), w)
    single = lambda s: F.filter(tokens(strip_quoted(s)), lambda w: (F.lower(w) == w) & (w.isin(common_words) | w.rlike(SHAPE)) & ~known(w))
    rest = lambda s: F.filter(tokens(s), lambda w: (F.upper(w) != w) & ~known(F.lower(w)))
    # Tokens are of A-Z and a-z alone, so comparing them in another case tells their shape.
    titled = lambda w: F.initcap(w) == w
    short = lambda w: (F.lower(w) == w) & (F.length(w) <= 5)
    pinyin = lambda ws: (F.size(ws) >= 2) & F.exists(ws, titled) & F.forall(ws, lambda w: titled(w) | short(w))

    def by_letters(s: Column, cjk: Column) -> Column:
        return F.when(mostly(cjk, count_of(s, "a-zA-Z"), MOSTLY), single(s)).when(cjk == 0, rest(s)).otherwise(let(rest(s), lambda ws: F.when(F.forall(ws, titled) | pinyin(ws), none).otherwise(ws)))

    # Of a long run of CJK characters only the number matters.  URLs may end inside one, so they go before.
    squeezed = lambda s, x: let(strip_hosts(x), lambda y: let(F.length(s) - F.length(x) + count_of(y, CJK), lambda cjk: by_letters(y, cjk)))
    return let(strip_urls(text), lambda s: let(squeeze_cjk(s), lambda x: squeezed(s, x)))


def is_candidate(text: Column) -> Column:
    """Whether a text can have residue at all: three lower-case letters in a row."""
    return F.coalesce(text.rlike("[a-z]{3}"), F.lit(False))


def relevant_terms(text: Column, glossary: Column) -> Column:
    """The entries of a glossary map whose term is in the text, compared in lower case; longest terms first, as an array of entries."""
    found = F.filter(F.map_entries(glossary), lambda e: F.contains(F.lower(text), F.lower(e["key"])))
    return F.array_sort(found, lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def keeps_retry(before: Column, after: Column) -> Column:
    """Whether a second answer is taken: only if it leaves strictly fewer words."""
    return F.size(after) < F.size(before)


def accepts_repair(before: Column, after: Column, old: Column, new: Column) -> Column:
    """Whether a repaired translation replaces the old one: fewer words left, and at least 0.6 of its length."""
    return (F.size(after) < F.size(before)) & (F.length(new) >= 0.6 * F.length(old))
