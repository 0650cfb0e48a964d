"""Text rules as Column expressions: matching, snippets, language, estimates, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word boundary between ASCII word characters and anything else, whatever the regex engine takes ``\b`` for.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: CJK punctuation, kana, Han and Hangul syllables.
CJK = "　-鿿가-힯"


def fold(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def holds(text: Column, query: Column) -> Column:
    """Whether the text has the query as a literal substring, ASCII letters compared without case."""
    return F.contains(fold(text), fold(query))


def escape_like(query: Column) -> Column:
    """A backslash before each backslash, percent sign and underscore."""
    return F.regexp_replace(query, r"([\\%_])", r"\\$1")


def snippet(text: Column, query: Column, radius: int = 40) -> Column:
    """The first hit (compared in lower case) with ``radius`` characters on each side and an ellipsis where it is cut; null without a hit."""
    at = F.instr(F.lower(text), F.lower(query))
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text), at - 1 + F.length(query) + radius)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))
    return F.when((F.length(query) > 0) & (at > 0), cut)


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every hit of the query, compared without case, between the two marks."""
    return F.regexp_replace(text, "(?i)" + "".join(c if c.isalnum() else f"\\{c}" if ord(c) < 128 else c for c in query), f"{before}$0{after}")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the class the text has; null has none.

    They are taken out run by run, as counting hits would make an object of each.
    """
    return let(text, lambda s: F.coalesce(F.length(s) - F.length(F.regexp_replace(s, f"[{characters}]+", "")), F.lit(0)).cast("long"))


#: Code, characters that count for it, the count from which on it is chosen; in the order of the decision.
SCRIPTS = [("ko", "가-힯ᄀ-ᇿ㄰-㆏", 51), ("ja", "぀-ヿ", 51), ("zh", "一-鿿", 51), ("ru", "Ѐ-ӿ", 51)]
DIACRITICS = [("es", "ñáéíóúÁÉÍÓÚÑ¿¡"), ("fr", "çàâæèêëîïôùûüÿœÇÀÂÆÈÊËÎÏÔÙÛÜŸŒ"), ("de", "äöüÄÖÜß")]
SAMPLE, LEAST_DIACRITICS = 20_000, 10


def detect_language(text: Column, own_letters_only: bool = False) -> Column:
    """Language code by scripts, else by the most frequent diacritics (ties in the order of the list), else ``en``.

    ``own_letters_only`` leaves letters out that two lists share, a corrected variant: é counts for Spanish alone otherwise.
    """
    sample = F.substring(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), 1, SAMPLE)
    shared = {c for _, a in DIACRITICS for c in a if sum(c in b for _, b in DIACRITICS) > 1} if own_letters_only else set()
    lists = [(code, "".join(c for c in letters if c not in shared)) for code, letters in DIACRITICS]

    def by_diacritics(n: Column) -> Column:
        most, out = F.array_max(n), F.lit("en")
        for i, (code, _) in reversed([*enumerate(lists)]):
            out = F.when((n[i] == most) & (most >= LEAST_DIACRITICS), code).otherwise(out)
        return out

    def by_scripts(s: Column) -> Column:
        out = let(F.array(*[count_of(s, letters) for _, letters in lists]), by_diacritics)
        for code, letters, least in reversed(SCRIPTS):
            out = F.when(count_of(s, letters) >= least, code).otherwise(out)
        # Most texts have no letter of these scripts: one look tells.
        return F.when(s.rlike("[" + "".join(letters for _, letters, _ in SCRIPTS) + "]"), out).otherwise(let(F.array(*[count_of(s, letters) for _, letters in lists]), by_diacritics))

    return let(sample, by_scripts)


def batch_tokens(text: Column) -> Column:
    """ceil(cjk / 2 + rest / 4)."""
    cjk = count_of(text, CJK)
    return F.ceil(cjk / 2 + (F.length(text) - cjk) / 4).cast("long")


def billed_tokens(text: Column) -> Column:
    """ceil(length / 3); 0 for null or blank texts."""
    return F.when(text.isNull() | (F.trim(F.regexp_replace(text, r"\s", " ")) == ""), 0).otherwise(F.ceil(F.length(text) / 3)).cast("long")


def output_factor(language: Column) -> Column:
    """How many output tokens an input token is billed as."""
    code = F.lower(language)
    return F.when(code == "zh", 1.5).when(code == "ja", 1.4).when(code == "ko", 1.3).otherwise(1.2)


def credits(tokens: Column, language: Column, per_credit: int = 100) -> Column:
    """ceil((in + ceil(in * factor)) / per_credit)."""
    return F.ceil((tokens + F.ceil(tokens * output_factor(language))) / per_credit).cast("long")


# Endings of host names and files that citations are known by.
HOST_ENDINGS = "com|org|net|gov|edu|io|co|cn|jp|de|fr|uk|us|ru|au|tv|info|news|me"
FILE_ENDINGS = "shtml|html?|pdf|txt|aspx?|jsp|php|csv|json|xml"


def _spaced(text: Column, pattern: str, holds) -> Column:
    """Each match becomes a space; ``holds`` tells cheaply of most texts that they have none."""
    return let(text, lambda s: F.when(holds(s), F.regexp_replace(s, pattern, " ")).otherwise(s))


def strip_urls(text: Column) -> Column:
    return _spaced(text, r"(?i)https?://\S+", lambda s: F.contains(s, F.lit("://")))


def strip_hosts(text: Column) -> Column:
    """What ``strip_citations`` takes out after URLs; all of it is ASCII."""
    # What a match begins with is looked for before edges: in CJK text that is one look a character instead of four.
    out = _spaced(text, r"(?=[\w.+-])" + EDGE + r"[\w.+-]++@[\w-]+(?:\.[\w-]+)+" + EDGE, lambda s: F.contains(s, F.lit("@")))
    host = r"(?i)(?=[\w-])" + EDGE + rf"(?:[\w-]++\.)+(?:{HOST_ENDINGS})(?:\.[a-z]{{2}})?(?:/[\w\-./?#=&%~+]*)?"
    out = _spaced(out, host, lambda s: s.rlike(rf"(?i)\.(?:{HOST_ENDINGS})"))
    return _spaced(out, rf"(?i)\.(?:{FILE_ENDINGS})" + EDGE, lambda s: s.rlike(rf"(?i)\.(?:{FILE_ENDINGS})"))


def strip_citations(text: Column) -> Column:
    """URLs, e-mail addresses, bare host names with paths, and file endings become a space each."""
    return strip_hosts(strip_urls(text))


#: The most characters that a quotation has.
QUOTED = 120


def squeeze_cjk(text: Column) -> Column:
    """A run of CJK characters that no quotation can hold becomes the shortest such run."""
    return F.regexp_replace(text, f"(?<![{CJK}])[{CJK}]{{{QUOTED + 2},}}+", "书" * (QUOTED + 1))


def strip_quoted(text: Column) -> Column:
    """Short spans in quotation marks or round brackets become a space each."""
    for left, right, most in (("“", "”", QUOTED), ("‘", "’", QUOTED), ('"', '"', QUOTED), ("'", "'", 80), ("（", "）", QUOTED), (r"\(", ")", QUOTED)):
        close = "\\)" if right == ")" else right
        text = _spaced(text, f"{left}[^{right}]{{0,{most}}}{close}", lambda s, left=left[-1]: F.contains(s, F.lit(left)))
    return text


# -- names, addresses, keys ---------------------------------------------------------------------------------


def slugify(title: Column, most: int = 40) -> Column:
    out = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")
    out = F.substring(F.regexp_replace(F.regexp_replace(out, "^_", ""), "_$", ""), 1, most)
    return F.when(F.coalesce(out, F.lit("")) == "", "book").otherwise(out)


def author(name: Column) -> Column:
    """"Last, First" becomes "First Last", if there are exactly two parts."""
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.concat_ws(" ", parts[1], parts[0])).otherwise(F.trim(name))


def email(raw: Column) -> Column:
    """Trimmed and lower-cased, or null if it does not look like an address."""
    out = F.lower(F.trim(raw))
    return F.when((F.length(out) <= 254) & out.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), out)


def abuse_key(address: Column) -> Column:
    """One inbox, one key: what follows a plus sign goes, and Gmail's dots."""
    domain = F.regexp_extract(address, r"@([^@]*)$", 1)
    local = F.regexp_replace(F.regexp_replace(address, r"@[^@]*$", ""), r"\+.*$", "")
    return F.concat(F.when(domain.isin("gmail.com", "googlemail.com"), F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.lit("@"), domain)


# Domains of throw-away mailboxes.
THROWAWAY = [
    "mailinator.com", "guerrillamail.com", "guerrillamail.info", "10minutemail.com", "temp-mail.org", "tempmail.com", "throwawaymail.com", "yopmail.com", "sharklasers.com",
    "trashmail.com", "getnada.com", "maildrop.cc", "dispostable.com", "fakeinbox.com", "tempinbox.com", "mail.tm", "mohmal.com", "linshiyouxiang.net", "zwoho.com", "chacuo.net",
]


def is_throwaway(address: Column) -> Column:
    return F.regexp_extract(address, r"@([^@]*)$", 1).isin(THROWAWAY)


def code_hash(address: Column, code: Column) -> Column:
    return F.sha2(F.concat(address, F.lit(":"), code), 256)


def zip_path(path: Column) -> Column:
    """The path without ``.``, ``..`` and empty segments."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x.isin(".", ""), out).otherwise(F.array_append(out, x)),
    )
    return F.array_join(kept, "/")


def decode_entities(text: Column) -> Column:
    """Entities in a fixed order (so ``&amp;lt;`` becomes ``<``), then white space is collapsed and trimmed."""
    for name, character in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(name), F.lit(character))
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,5});"), F.lit(1)))
    # Numbers from 128 on are built from their UTF-16 bytes, as chr() stops at 255.
    two = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("int")), 4, "0")), "UTF-16BE")
    text = F.aggregate(codes, text, lambda out, c: F.replace(out, F.concat(F.lit("&#"), c, F.lit(";")), two(c)))
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}\x{3000}]+", " "))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def is_heading_like(text: Column) -> Column:
    """Neither opens like dialogue nor holds a sentence's end."""
    return ~(text.rlike("^[“”\"'‘「『〈《（(]") | text.rlike("[。？！?!]"))


#: File-name patterns and the role of the matter, in the order of the decision.
MATTER = [
    ("cover", "Cover"), ("half[-_]?title", "Title Page"), (f"title[-_]?page|^title{EDGE}", "Title Page"), ("copyright|colophon|imprint", "Copyright"), ("dedicat", "Dedication"),
    ("acknowledg", "Acknowledgments"), ("epigraph", "Epigraph"), ("foreword", "Foreword"), ("preface", "Preface"), ("prologue", "Prologue"), ("epilogue", "Epilogue"),
    ("afterword", "Afterword"), ("appendix", "Appendix"), ("glossary", "Glossary"), ("biblio", "Bibliography"), ("about[-_]?(the[-_]?)?author", "About the Author"),
    ("front[-_]?matter", "Front Matter"), ("back[-_]?matter", "Back Matter"), (f"{EDGE}toc{EDGE}|contents", "Contents"),
]


def matter_role(path: Column) -> Column:
    """Front or back matter by the file's name; empty if it is none."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    out = F.lit("")
    for pattern, role in reversed(MATTER):
        out = F.when(base.rlike(f"(?i){pattern}"), role).otherwise(out)
    return out


#: Parts of class names that verse is known by.
VERSE = ["poem", "verse", "stanza", "poetry", "calibre_", "song", "lyrics"]


def paragraph_type(text: Column, tag: Column, css_class: Column) -> Column:
    """title, chapter, poem or normal, by tag, class, opening words and line lengths."""
    named = F.lower(F.coalesce(css_class, F.lit("")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    average = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x)) / F.size(lines)
    verse = F.lit(False)
    for word in VERSE:
        verse = verse | F.contains(named, F.lit(word))
    return (
        F.when(F.lower(F.coalesce(tag, F.lit(""))).isin("h1", "h2", "h3") | F.contains(named, F.lit("title")), "title")
        .when(text.rlike(r"(?i)^(chapter|part)\s+[ivxlcdm\d]+"), "chapter").when(verse, "poem")
        .when((F.size(lines) > 2) & (average < 60), "poem").otherwise("normal")
    )


# -- model output -------------------------------------------------------------------------------------------


def trimmed(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def segments(answer: Column) -> Column:
    """Map of segment id to text for each ``<seg id="N">text</seg>``; of a repeated id the last one counts."""
    pattern = r'(?s)<seg\s+id="(\d+)">(.*?)</seg>'
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda x: x.cast("int")).alias("id"),
        F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)), trimmed).alias("text"),
    )
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["id"])), lambda i: F.struct(i, F.element_at(F.filter(pairs, lambda p: p["id"] == i), -1)["text"])))


def repaired_map(raw: Column) -> Column:
    """A JSON object of strings; one that was cut off is closed after its last whole entry; null if neither parses."""
    kind = "map<string,string>"
    at = F.length(raw) - F.instr(F.reverse(raw), F.lit(',"'))  # up to the quotation mark before the last comma that follows one
    mended = F.concat(F.substring(raw, F.lit(1), at), F.lit("}"))
    # A cut-off entry would parse to null in permissive mode, so the repair is tried where the whole is no valid object.
    return F.coalesce(F.when(raw.rlike(r"\}\s*$"), F.from_json(raw, kind)), F.when(F.contains(raw, F.lit('",')), F.from_json(mended, kind)))


def titled(raw: Column) -> Column:
    """The title in a model's answer: a JSON object, fenced or not, or a bare line."""
    text = F.trim(raw)
    text = F.when(text.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(text)
    return F.coalesce(F.get_json_object(text, "$.title"), F.when(~text.rlike(r"[{}\n]"), text))


def paragraphs(text: Column, large: int = 3000) -> Column:
    """The parts that a large text is worked on in: its paragraphs, else its lines, else the whole; smaller texts stay whole.  Blank parts are left out."""
    parts = lambda pattern: F.filter(F.split(text, pattern), lambda x: F.trim(x) != "")
    by_paragraph, by_line = parts("\n\n+"), parts("\n")
    return F.when(F.length(text) <= large, F.array(text)).when(F.size(by_paragraph) > 1, by_paragraph).when(F.size(by_line) > 1, by_line).otherwise(F.array(text))


# -- pages and files ------------------------------------------------------------------------------------------

#: What short navigation lines hold, and what blocks of rights hold.
NAVIGATION = [
    "table of contents", "contents", "chapter", "section", "copyright", "©", "all rights reserved", "license", "legal", "disclaimer", "imprint", "impressum", "publisher",
    "previous", "next", "back", "forward", "home", "page", "pg.", "cover", "title page", "index",
]
RIGHTS = ["copyright", "©", "all rights reserved"]


def is_navigation_or_rights(text: Column) -> Column:
    """A line of fewer than 50 characters that names navigation, or a block of fewer than 300 that names rights."""
    any_of = lambda s, words: F.exists(F.lit(words), lambda w: F.contains(s, w))
    return let(F.lower(F.trim(text)), lambda s: ((F.length(s) < 50) & any_of(s, NAVIGATION)) | ((F.length(s) < 300) & any_of(s, RIGHTS)))


def file_number(path: Column) -> Column:
    """The last number in a file's name; files without one come after all others (null)."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("")).cast("long")


def stored_html(html: Column, most: int = 50_000) -> Column:
    """A chapter's markup if it is short enough to be stored with it (fewer than ``most`` bytes), else null."""
    return F.when((F.octet_length(html) > 0) & (F.octet_length(html) < most), html)


def with_image_sources(html: Column, stored: Column) -> Column:
    """Markup whose ``img`` sources are replaced by what the map ``stored`` has for them: by the whole path, without leading ``../``, or by the file's name."""
    pattern = r'(?i)<img[^>]*\ssrc="([^"]*)"'
    sources = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))

    def new(s: Column) -> Column:
        return F.coalesce(F.try_element_at(stored, s), F.try_element_at(stored, F.regexp_replace(s, r"^(\.\./)+", "")), F.try_element_at(stored, F.element_at(F.split(s, "/"), -1)))

    return F.aggregate(sources, html, lambda out, s: F.coalesce(F.replace(out, F.concat(F.lit(' src="'), s, F.lit('"')), F.concat(F.lit(' src="'), new(s), F.lit('"'))), out))


def signature(payload: Column, stamp: Column, secret: str) -> Column:
    """HMAC-SHA256 of ``stamp.payload`` as lower-case hex, from its definition: two hashes over the padded key."""
    import hashlib

    raw = secret.encode()
    key = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda n: F.lit(bytearray(b ^ n for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(F.concat(stamp, F.lit("."), payload), "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
