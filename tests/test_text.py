import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers, residue, text, titles

WORDS = ["simply", "exactly", "further", "somehow", "otherwise"]


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).coalesce(1).select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "x string", f(F.col("x")))[0][0]


@pytest.mark.parametrize("text_, query, radius, expected", [
    ("nothing here", "zzz", 40, None), ("", "a", 40, None), ("abc", "", 40, None), ("The Quick fox", "quick", 40, "The Quick fox"),
    ("a" * 100 + "NEEDLE" + "b" * 100, "needle", 10, "…" + "a" * 10 + "NEEDLE" + "b" * 10 + "…"), ("NEEDLE" + "b" * 50, "needle", 10, "NEEDLE" + "b" * 10 + "…"), ("a" * 50 + "NEEDLE", "needle", 10, "…" + "a" * 10 + "NEEDLE"),
])
def test_snippet(spark, text_, query, radius, expected):
    assert values(spark, [(text_, query)], "t string, q string", text.snippet(F.col("t"), F.col("q"), radius)) == [(expected,)]


def test_literal_matches(spark):
    assert one(spark, r"100% foo_bar a\b", text.escape_like) == r"100\% foo\_bar a\\b"
    assert one(spark, "ÉAbZ", text.fold) == "Éabz"
    assert one(spark, "a.b A.B", lambda x: text.highlight(x, "a.b")) == "<mark>a.b</mark> <mark>A.B</mark>"


@pytest.mark.parametrize("text_, code", [("한" * 51, "ko"), ("ひ" * 30 + "カ" * 30, "ja"), ("字" * 51, "zh"), ("字" * 50, "en"), ("я" * 60, "ru"), ("ñ" * 10, "es"), ("ç" * 10, "fr"), ("ß" * 10, "de"), ("é" * 10, "es"), (None, "en")])
def test_language(spark, text_, code):
    assert one(spark, text_, text.detect_language) == code


def test_estimates(spark):
    assert one(spark, "字字字abcd", text.batch_tokens) == 3
    assert one(spark, "abcd", text.billed_tokens) == 2 and one(spark, "  \n", text.billed_tokens) == 0 and one(spark, None, text.billed_tokens) == 0
    assert values(spark, [(100, "zh"), (100, "en")], "n long, l string", text.credits(F.col("n"), F.col("l"))) == [(3,), (3,)]


@pytest.mark.parametrize("text_, expected", [
    ("他在网站example.com上看到了这篇文章，觉得很有意思也很重要", []), ("参见http://www.example.org/a/b.shtml的文章，内容非常完整", []), ("请写信给someone@mail.example.edu询问这件事情的经过", []),
    ("这只狗 the dog ran very fast across the field.", ["dog", "ran", "very", "fast", "across", "field"]), ("这本书simply是最好的一本书，大家都应该读一读", ["simply"]), ("他说这是“simply the best”的一本书，所以大家都应该找来认真地读一读", []),
    ("他毫无疑问arguably是历史上最好的运动员之一，大家都这么认为", ["arguably"]), ("美国的NASA和欧洲的ESA都参加了这个重要的项目", []), ("王小明 Wang Xiao ming", []), ("张三 John Smith Mary", []), ("这是一段完全干净的中文。", []), (None, None),
])
def test_residue(spark, text_, expected):
    assert one(spark, text_, lambda x: residue.residue(x, WORDS)) == expected


def test_residue_glossary(spark):
    glossary = F.create_map(F.lit("simply"), F.lit("simply"))
    assert one(spark, "这本书simply是最好的一本书，大家都应该读一读", lambda x: residue.residue(x, WORDS, residue.allowed_words(glossary))) == []
    assert one(spark, "A dog and a hot dog", lambda x: F.transform(residue.relevant_terms(x, F.create_map(*map(F.lit, ("dog", "D", "hot dog", "H", "cat", "C")))), lambda e: e["key"])) == ["hot dog", "dog"]


@pytest.mark.parametrize("raw, clean", [
    ("The Example Book (A Novel)", "The Example Book"), ("《自动钢琴》", "自动钢琴"), ("一本好书（推荐语）", "一本好书"), ("A / B", "A / B"), ("Title. Second Edition with notes", "Title"), ("“Quoted”", "Quoted"),
    ("Name | Kindle Edition", "Name"), ("《书名》：副题", "书名：副题"), ("(only brackets)", "(only brackets)"), ("", ""),
])
def test_titles(spark, raw, clean):
    assert one(spark, raw, titles.clean_title) == clean


@pytest.mark.parametrize("title, spine", [("主题：副题很长", "主题"), ("Main: Sub", "Main"), ("The Beginning of Infinity", "The Beginning of Infinity"), ("The Elements of Computing Systems and More", "Computing Systems and More")])
def test_spine(spark, title, spine):
    assert one(spark, title, titles.spine_title) == spine


def test_usable_title(spark):
    ok = lambda o, f, c: values(spark, [(o, f, c)], "o string, f string, c string", titles.usable_title(F.col("o"), F.col("f"), F.col("c")))[0][0]
    assert ok("A Long Book Title", "A Long Book Title", "Long Book") and not ok("A Book", "A Book", "一本书") and not ok("Main: Sub title", "Main: Sub title", "Main")


def test_names(spark):
    assert one(spark, "Doe, Jane", text.author) == "Jane Doe" and one(spark, "A, B, C", text.author) == "A, B, C"
    assert one(spark, " The Book! ", text.slugify) == "the_book" and one(spark, "书", text.slugify) == "book"
    assert one(spark, " A.B+x@Gmail.com ", text.email) == "a.b+x@gmail.com" and one(spark, "no at", text.email) is None
    assert one(spark, "a.b+x@gmail.com", text.abuse_key) == "ab@gmail.com" and one(spark, "a.b+x@example.org", text.abuse_key) == "a.b@example.org"
    assert one(spark, "x@yopmail.com", text.is_throwaway)
    assert one(spark, "a/./b/../c//d", text.zip_path) == "a/c/d" and one(spark, "../a", text.zip_path) == "a"
    assert one(spark, "a&nbsp;b &amp;lt; &#233;&#8217;  x", text.decode_entities) == "a b < é’ x"
    assert one(spark, "OEBPS/about-the-author.xhtml", text.matter_role) == "About the Author" and one(spark, "c1.html", text.matter_role) == ""
    assert one(spark, "a" * 20, lambda x: text.truncate(x, 10)) == "a" * 7 + "..."


def test_paragraph_type(spark):
    rows = [("x", "H1", None, "title"), ("Chapter IV", "p", "", "chapter"), ("a\nb\nc", "p", "", "poem"), ("x", "p", "verse-1", "poem"), ("plain", "p", "x", "normal")]
    assert [r[1] for r in values(spark, rows, "t string, g string, c string, e string", "e", text.paragraph_type(F.col("t"), F.col("g"), F.col("c")))] == [r[3] for r in rows]


def test_answers(spark):
    assert one(spark, '<seg id="1"> a </seg><seg id="2">b\nc</seg><seg id="1">d</seg>', text.segments) == {1: "d", 2: "b\nc"}
    assert one(spark, "none", text.segments) == {}
    assert one(spark, '{"a":"x","b":"y', text.repaired_map) == {"a": "x"} and one(spark, '{"a":"x"}', text.repaired_map) == {"a": "x"}
    assert one(spark, '```json\n{"title":"T"}\n```', text.titled) == "T" and one(spark, "Bare", text.titled) == "Bare" and one(spark, "a\nb", text.titled) is None


@pytest.mark.parametrize("stamp, millis", [(None, 0), ("", 0), ("2024-03-24 13:00:00", 1711285200000), ("2024-03-24T13:00:00Z", 1711285200000), ("2024-03-24T21:00:00+08:00", 1711285200000), ("garbage", 0)])
def test_cloud_time(spark, stamp, millis):
    assert one(spark, stamp, numbers.cloud_millis) == millis


def test_progress_fault(spark):
    f = numbers.progress_fault(*map(F.col, ("p", "c", "x", "r", "k", "l")))
    rows = [(50, 1, "x", 0, 0, "l"), (101, 1, "x", 0, 0, "l"), (50, 0, "x", 0, 0, "l"), (50, 1, "x" * 501, 0, 0, "l"), (50, 1, "x", 51, 0, "l"), (50, 1, "x", 0, 0, "l" * 61)]
    assert [r[0] for r in values(spark, rows, "p int, c int, x string, r int, k int, l string", f)] == [None, *numbers.FAULTS]


def test_nested_marks_of_any_depth(spark):
    marks = [("“", "”"), ("《", "》"), ('"', '"'), ("'", "'")]
    rows = []
    for depth in (1, 3, 5, 12):
        title = "Name"
        for n in range(depth):
            left, right = marks[n % 4]
            title = left + title + right
        rows += [(title, "quotes"), ("Name" + "(a)[b] " * depth, "brackets")]
    df = spark.createDataFrame([*rows, (None, "quotes"), ("", "brackets"), ("'", "quotes")], "t string, kind string")
    got = df.select("t", F.when(F.col("kind") == "quotes", titles.without_quotes(F.col("t"))).otherwise(titles.without_brackets(F.col("t"))).alias("x")).collect()
    assert [r.x for r in got] == ["Name"] * len(rows) + [None, "", "'"]


# -- what large texts cost --------------------------------------------------------------------------------------


EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
CITATIONS = [
    r"(?i)https?://\S+", EDGE + r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+" + EDGE,
    r"(?i)" + EDGE + rf"(?:[\w-]+\.)+(?:{text.HOST_ENDINGS})(?:\.[a-z]{{2}})?(?:/[\w\-./?#=&%~+]*)?", rf"(?i)\.(?:{text.FILE_ENDINGS})" + EDGE,
]
QUOTATIONS = ["“[^”]{0,120}”", "‘[^’]{0,120}’", '"[^"]{0,120}"', "'[^']{0,80}'", "（[^）]{0,120}）", r"\([^)]{0,120}\)"]


def test_counts_make_no_array_of_hits(spark):
    """Characters are counted without an object for each, and texts without what a pattern needs pass it by."""
    counted = spark.createDataFrame([("书書a1 不B한é",), (None,), ("",), ("\U00020000书",)], "x string")
    df = counted.select(text.count_of(F.col("x"), text.CJK).alias("cjk"), text.count_of(F.col("x"), "a-zA-Z").alias("latin"))
    assert [tuple(r) for r in df.collect()] == [(4, 2), (0, 0), (0, 0), (1, 0)]
    left = counted.select(residue.residue(F.col("x"), WORDS).alias("w"), text.detect_language(F.col("x")).alias("l"), text.batch_tokens(F.col("x")).alias("n"))
    for rows in (df, left):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "[a-zA-Z]," not in plan and f"[{text.CJK}]," not in plan


def test_residue_of_long_runs(spark):
    """Runs of CJK characters about as long as the longest quotation, in quotations, URLs and beside words, count as they did."""
    rnd = random.Random(4)
    runs = ["书" * n for n in (1, 40, 118, 119, 120, 121, 122, 123, 300)]
    parts = [*runs, "“", "”", "(", ")", " ", "http://a.b/", "simply ", "Wang", "fixedly", "dog ", "x@y.com", "，", "words " * 40]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(1500)]

    def by_hand(x):
        for pattern in CITATIONS:
            x = re.sub(pattern, " ", x, flags=re.ASCII)
        cjk, latin = len(re.findall(f"[{text.CJK}]", x)), len(re.findall("[a-zA-Z]", x))
        words = lambda y: re.findall("[a-zA-Z]{3,}", y)
        rest = [w for w in words(x) if w.upper() != w and w.lower() not in residue.LET_THROUGH]
        if cjk and cjk / (cjk + latin) >= residue.MOSTLY:
            for pattern in QUOTATIONS:
                x = re.sub(pattern, " ", x)
            return [w for w in words(x) if w.islower() and w not in residue.LET_THROUGH and (w in WORDS or re.search(residue.SHAPE, w))]
        titled = [w.capitalize() == w for w in rest]
        pinyin = len(rest) >= 2 and any(titled) and all(t or (w.islower() and len(w) <= 5) for w, t in zip(rest, titled))
        return [] if cjk and (all(titled) or pinyin) else rest

    got = values(spark, [(x,) for x in texts], "x string", residue.residue(F.col("x"), WORDS))
    assert [g for (g,) in got] == [by_hand(x) for x in texts] and len({tuple(g) for (g,) in got}) > 50
    assert values(spark, [("书" * 9000 + " simply",)], "x string", F.length(text.squeeze_cjk(F.col("x")))) == [(text.QUOTED + 8,)]


def test_guarded_patterns_equal_plain_ones(spark):
    """Citations and quotations by one pattern after the other, in Python, over odd mixtures of their parts."""
    rnd = random.Random(3)
    parts = ["http", "HTTPS", "://", ":", "a", "b-c", "-", "_", "+", ".", ".", "@", "@", "书", "é", " ", "com", "Co", "uk", "html", "pdf", "/x?y=1", "“", "”", "‘", "’", '"', "'", "（", "）", "(", ")", "word " * 20]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(3000)]

    def by_hand(x, patterns):
        for pattern in patterns:
            x = re.sub(pattern, " ", x, flags=re.ASCII)
        return x

    got = values(spark, [(x,) for x in texts], "x string", text.strip_citations(F.col("x")), text.strip_quoted(F.col("x")))
    assert got == [(by_hand(x, CITATIONS), by_hand(x, QUOTATIONS)) for x in texts]
