"""Text rules, glossaries and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import residue as R
from quire.functions import text as X
from quire.functions import titles
from quire.operators import evaluation
from quire.plans.registry import query
from quire.sources.tables import table

#: A small word list for the scan of mostly CJK texts; users give their own.
COMMON_WORDS = ["simply", "exactly", "further", "however", "because", "otherwise", "somehow"]
#: A glossary of terms of the synthetic corpus.
GLOSSARY = {"the": "der", "and": "und", "que": "dass", "ing": "ung", "ou": "wo"}
GLOSSARY_SQL = "g(term, translation) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GLOSSARY.items()) + ")"


def _count(x: str, characters: str) -> str:
    return f"length(regexp_replace({x}, '[^{characters}]', '', 'g'))"


def _language_sql() -> str:
    counts = ", ".join(f"{_count('s', letters)} AS {code}" for code, letters, *_ in [*X.SCRIPTS, *X.DIACRITICS])
    scripts = " ".join(f"WHEN {code} >= {least} THEN '{code}'" for code, _, least in X.SCRIPTS)
    latin = " ".join(f"WHEN greatest(es, fr, de) >= {X.LEAST_DIACRITICS} AND {code} = greatest(es, fr, de) THEN '{code}'" for code, _ in X.DIACRITICS)
    return f"WITH t AS (SELECT doc_id, substr(' ' || text, 1, {X.SAMPLE}) AS s FROM documents), c AS (SELECT doc_id, {counts} FROM t) SELECT doc_id, CASE {scripts} {latin} ELSE 'en' END AS language FROM c"


@query(_language_sql())
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


CJK_COUNT = _count("text", X.CJK)
BILLED = "CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s', ' ', 'g')) = '' THEN 0 ELSE ceil(length(text) / 3) END::BIGINT"


@query(f"SELECT doc_id, ceil({CJK_COUNT} / 2 + (length(text) - {CJK_COUNT}) / 4)::BIGINT AS batch_tokens, {BILLED} AS billed_tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.batch_tokens(F.col("text")).alias("batch_tokens"), X.billed_tokens(F.col("text")).alias("billed_tokens"))


@query(f"""
    WITH t AS (SELECT source, sum({BILLED})::BIGINT AS tokens FROM documents GROUP BY source), l(language, f) AS (VALUES ('zh', 1.5::DOUBLE), ('ja', 1.4::DOUBLE), ('ko', 1.3::DOUBLE), ('en', 1.2::DOUBLE))
    SELECT source, language, tokens, ceil((tokens + ceil(tokens * f)) / 100)::BIGINT AS credits FROM t, l""")
def credit_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the translation of each source into each of four languages is billed."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(X.billed_tokens(F.col("text"))).alias("tokens"))
    rows = rows.withColumn("language", F.explode(F.array(*map(F.lit, ("zh", "ja", "ko", "en")))))
    return rows.withColumn("credits", X.credits(F.col("tokens"), F.col("language")))


def _citations_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)https?://\\S+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)\\b(?:[\\w-]+\\.)+(?:{X.HOST_ENDINGS})(?:\\.[a-z]{{2}})?(?:/[\\w\\-./?#=&%~+]*)?', ' ', 'g')"
    return f"regexp_replace({x}, '(?i)\\.(?:{X.FILE_ENDINGS})\\b', ' ', 'g')"


@query(f"SELECT page_id, {_citations_sql('url')} AS url, md5({_citations_sql('html')}) AS html_hash FROM pages")
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and host names become spaces; the page itself is shown by its hash."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_citations(F.col("url")).alias("url"), F.md5(X.strip_citations(F.col("html"))).alias("html_hash"))


@query(f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({_citations_sql('text')}, '[a-zA-Z]{{3,}}') AS words FROM documents)
    SELECT doc_id, len(k) AS n, k[1] AS first FROM (SELECT doc_id, list_filter(words, lambda w: NOT list_contains({R.LET_THROUGH}, lower(w)) AND NOT regexp_matches(w, '^[A-Z]+$')) AS k FROM w)""")
def latin_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and first of the English words that a text holds."""
    words = R.residue(F.col("text"), COMMON_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.try_element_at("w", F.lit(1)).alias("first"))


@query(f"""
    WITH {GLOSSARY_SQL}, f AS (SELECT doc_id, term FROM documents, g WHERE contains(lower(text), lower(term)))
    SELECT d.doc_id, coalesce((SELECT string_agg(term, ',' ORDER BY length(term) DESC, term) FROM f WHERE f.doc_id = d.doc_id), '') AS terms FROM documents d""")
def glossary_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the glossary that a text holds, longest first."""
    glossary = F.create_map(*[F.lit(x) for pair in GLOSSARY.items() for x in pair])
    found = R.relevant_terms(F.col("text"), glossary)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda e: e["key"]), ",").alias("terms"))


@query(f"""
    WITH {GLOSSARY_SQL}, c AS (SELECT lang, contains(lower(text), lower(translation)) AS kept FROM documents, g WHERE contains(lower(text), lower(term)))
    SELECT lang, count(*) AS checks, sum(kept::INTEGER)::BIGINT AS kept, sum(kept::INTEGER)::BIGINT / count(*) AS adherence FROM c GROUP BY lang""")
def glossary_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary = spark.createDataFrame(list(GLOSSARY.items()), "term string, translation string")
    checks = evaluation.term_checks(table(spark, sf_dir, "documents").select("lang", "text"), glossary, "text", "text")
    sums = checks.groupBy("lang").agg(F.count("*").alias("checks"), F.sum(F.col("kept").cast("int")).alias("kept"))
    return sums.withColumn("adherence", evaluation.ratio(F.col("kept"), F.col("checks")))


@query("""
    WITH e AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 3 = 0 THEN '+news' ELSE '' END || CASE c_custkey % 4 WHEN 0 THEN '@Gmail.com' WHEN 1 THEN '@yopmail.com' WHEN 2 THEN '@example.org' ELSE '@bad' END AS raw FROM customer),
    n AS (SELECT c_custkey, CASE WHEN length(trim(raw)) <= 254 AND regexp_matches(lower(trim(raw)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$') THEN lower(trim(raw)) END AS email FROM e),
    p AS (SELECT *, regexp_extract(email, '@([^@]*)$', 1) AS domain, regexp_replace(regexp_replace(email, '@[^@]*$', ''), '\\+.*$', '') AS local FROM n)
    SELECT c_custkey, email, CASE WHEN domain IN ('gmail.com', 'googlemail.com') THEN replace(local, '.', '') ELSE local END || '@' || domain AS abuse_key, domain = 'yopmail.com' AS throwaway, sha256(email || ':' || c_custkey) AS hash FROM p""")
def email_abuse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    host = F.when(key % 4 == 0, "@Gmail.com").when(key % 4 == 1, "@yopmail.com").when(key % 4 == 2, "@example.org").otherwise("@bad")
    raw = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.when(key % 3 == 0, "+news").otherwise(""), host)
    rows = table(spark, sf_dir, "customer").select(key, X.email(raw).alias("email"))
    return rows.select(key, "email", X.abuse_key(F.col("email")).alias("abuse_key"), X.is_throwaway(F.col("email")).alias("throwaway"), X.code_hash(F.col("email"), key.cast("string")).alias("hash"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'book' ELSE s END AS slug FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '^_', ''), '_$', ''), 1, 40) AS s FROM part)")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("""
    WITH r AS (SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN ', First' WHEN 1 THEN ', A, B' ELSE '' END AS raw FROM supplier),
    p AS (SELECT *, list_transform(string_split(raw, ','), lambda x: trim(x)) AS parts FROM r)
    SELECT s_suppkey, CASE WHEN len(parts) = 2 AND parts[1] <> '' AND parts[2] <> '' THEN parts[2] || ' ' || parts[1] ELSE trim(raw) END AS author FROM p""")
def author_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = F.concat("s_name", F.when(key % 3 == 0, ", First").when(key % 3 == 1, ", A, B").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.author(raw).alias("author"))


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE p_name || ': ' || p_type END AS title, p_name AS spine FROM part""")
def title_clean_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with quotation marks, bracketed descriptors, advertising and subtitles are cleaned, and shortened for the spine."""
    key = F.col("p_partkey")
    raw = F.when(key % 4 == 0, F.concat(F.lit("“"), "p_name", F.lit("” (A Novel)"))).when(key % 4 == 1, F.concat("p_name", F.lit("  | Kindle Edition"))).when(key % 4 == 2, F.concat(F.lit("《"), "p_name", F.lit("》")))
    raw = raw.otherwise(F.concat("p_name", F.lit(" :  "), "p_type"))
    rows = table(spark, sf_dir, "part").select(key, titles.clean_title(raw).alias("title"))
    return rows.withColumn("spine", titles.spine_title(F.col("title")))


def _matter_sql() -> str:
    import re

    base = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '')"
    cases = " ".join(f"WHEN regexp_matches({base}, '(?i){re.sub(re.escape(X.EDGE), lambda _: chr(92) + 'b', pattern)}') THEN '{role}'" for pattern, role in X.MATTER)
    names = "['OEBPS/cover.xhtml', 'text/half_title.html', 'title.html', 'entitle.html', 'a/copyright-page.xhtml', 'toc.ncx', 'stock.html', 'chapter1.html', 'about-the-author.xhtml', 'Appendix_A.html']"
    return f"WITH p AS (SELECT p_partkey, {names}[(p_partkey % 10 + 1)::INTEGER] AS path FROM part) SELECT p_partkey, path, CASE {cases} ELSE '' END AS role FROM p"


@query(_matter_sql())
def matter_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["OEBPS/cover.xhtml", "text/half_title.html", "title.html", "entitle.html", "a/copyright-page.xhtml", "toc.ncx", "stock.html", "chapter1.html", "about-the-author.xhtml", "Appendix_A.html"]
    path = F.element_at(F.lit(names), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), X.matter_role(path).alias("role"))


@query("""
    WITH l AS (SELECT doc_id, lang, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)
    SELECT doc_id, CASE WHEN lang = 'de' THEN 'title' WHEN regexp_matches(text, '(?i)^(chapter|part)\\s+[ivxlcdm\\d]+') THEN 'chapter'
                        WHEN len(lines) > 2 AND list_sum(list_transform(lines, lambda x: length(x))) / len(lines) < 60 THEN 'poem' ELSE 'normal' END AS type FROM l""")
def paragraph_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents stand in for headings."""
    tag = F.when(F.col("lang") == "de", "H1").otherwise("p")
    return table(spark, sf_dir, "documents").select("doc_id", X.paragraph_type(F.col("text"), tag, F.lit(None).cast("string")).alias("type"))


@query("SELECT conv_id, turn, trim(replace(text, '<', ' '), ' ' || chr(10) || chr(9) || chr(13)) AS found, NULL::VARCHAR AS lost FROM conversations")
def seg_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a tagged answer by id; one that is not there is null."""
    answer = F.concat(F.lit('ok <seg id="3"> '), F.replace("text", F.lit("<"), F.lit(" ")), F.lit(' </seg>\n<seg id="4">other</seg> <seg id="5">cut'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.segments(answer).alias("s"))
    return rows.select("conv_id", "turn", F.try_element_at("s", F.lit(3)).alias("found"), F.try_element_at("s", F.lit(5)).alias("lost"))


@query("SELECT n_nationkey, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'y' END AS b FROM nation")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object that was cut off loses its last, broken entry only."""
    raw = F.concat(F.lit('{"a":"'), "n_name", F.lit('","b":"y'), F.when(F.col("n_nationkey") % 2 == 0, '"}').otherwise(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.repaired_map(raw).alias("m")).select("n_nationkey", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


# -- evaluation ------------------------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT lang, CASE WHEN doc_id % 10 = 0 THEN '[Translation failed]' WHEN doc_id % 10 = 1 THEN '' ELSE text END AS t, n_chars % 3 = 0 AS has, doc_id % 2 AS checks, doc_id % 4 = 3 AS kept, doc_id % 5 > 0 AS parsed FROM documents),
    d AS (SELECT *, t IS NOT NULL AND t <> '' AND t <> '[Translation failed]' AS done FROM r)
    SELECT lang, sum(done::INTEGER)::BIGINT / count(*) AS completeness, sum((done AND has)::INTEGER)::BIGINT / sum(done::INTEGER)::BIGINT AS residue_rate, sum(kept::INTEGER)::BIGINT / sum(checks)::BIGINT AS adherence,
           sum(parsed::INTEGER)::BIGINT / count(*) AS parse_rate FROM d GROUP BY lang""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each language's documents, as if they were a model's translations."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "lang", F.when(key % 10 == 0, "[Translation failed]").when(key % 10 == 1, "").otherwise(F.col("text")).alias("translated_text"),
        F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("words"), (key % 2).alias("checks"), (key % 4 == 3).cast("int").alias("kept"), (key % 5 > 0).alias("parsed"),
    )
    return evaluation.metrics(rows, ["lang"], F.col("words"), F.col("checks"), F.col("kept"))


@query("""
    WITH s AS (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN event_id % 6 END AS accuracy, event_id % 4 AS fluency, event_id % 3 AS style, event_id % 7 AS terms FROM events),
    m AS (SELECT event_type, avg(coalesce(accuracy, 0)) AS accuracy, avg(fluency) AS fluency, avg(style) AS style, avg(terms) AS terms FROM s GROUP BY 1)
    SELECT event_type, round(accuracy, 9) AS accuracy, round((accuracy + fluency + style + terms) / 4, 9) AS overall FROM m""")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(key % 5 > 0, key % 6).alias("accuracy"), (key % 4).alias("fluency"), (key % 3).alias("style"), (key % 7).alias("terms"))
    means = evaluation.judge_means(rows, ["event_type"], ["accuracy", "fluency", "style", "terms"])
    return means.select("event_type", F.round("accuracy", 9).alias("accuracy"), F.round("overall", 9).alias("overall"))


@query("""
    WITH v AS (SELECT event_type AS tag, ['a', 'B ', 'tie', '??'][(event_id % 4 + 1)::INTEGER] AS winner FROM events),
    w AS (SELECT tag, CASE WHEN lower(trim(winner)) IN ('a', 'b') THEN lower(trim(winner)) ELSE 'tie' END AS w FROM v)
    SELECT tag, sum((w = 'a')::INTEGER)::BIGINT AS wins_a, sum((w = 'b')::INTEGER)::BIGINT AS wins_b, sum((w = 'tie')::INTEGER)::BIGINT AS wins_tie FROM w GROUP BY ROLLUP (tag)""")
def ab_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    winner = F.element_at(F.lit(["a", "B ", "tie", "??"]), (F.col("event_id") % 4 + 1).cast("int"))
    return evaluation.ab_tally(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), winner.alias("winner")), "tag")


@query("""
    WITH g AS (SELECT p_name AS term, regexp_replace(p_brand, '^Brand#', '') || CASE WHEN p_partkey % 3 = 0 THEN ' san' ELSE '' END AS translation FROM part),
    p AS (SELECT trim(regexp_replace(translation, ' san$', '', 'g')) AS plain, term FROM g)
    SELECT plain, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM p GROUP BY plain HAVING count(DISTINCT term) > 1""")
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that several terms share once honorifics are taken off."""
    translation = F.concat(F.regexp_replace("p_brand", "^Brand#", ""), F.when(F.col("p_partkey") % 3 == 0, " san").otherwise(""))
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), translation.alias("translation"))
    return evaluation.variant_groups(rows, " san$").select("plain", F.array_join("terms", ",").alias("terms"))


SCAN_SQL = """
    s AS (
        SELECT conv_id * 1000 + turn AS segment_id, conv_id, text, length(text) % 4 = 0 AS mostly, regexp_extract_all(text, '[a-z]{7,}') AS words FROM conversations
        WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4)),
    f AS (SELECT * FROM s WHERE mostly AND len(words) > 0)"""


def _scanned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), F.col("conv_id").alias("chapter_id"), "text")
    sizes = rows.groupBy(F.col("chapter_id").alias("id")).agg(F.count("*").alias("n"))
    chapters = sizes.select("id", F.col("id").alias("book_id"))
    books = sizes.select("id", F.when(F.col("n") >= 4, "en-zh").otherwise("en-none").alias("language_pair"))
    return evaluation.corpus_scan(rows, chapters, books, F.regexp_extract_all("text", F.lit("([a-z]{7,})"), F.lit(1)), F.length("text") % 4 == 0)


@query(f"WITH {SCAN_SQL}, w AS (SELECT unnest(words) AS word FROM f) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25")
def corpus_scan_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a corpus scan flags most often."""
    return _scanned(spark, sf_dir)["words"]


@query(f"""
    WITH {SCAN_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (mostly) AS eligible, (SELECT count(*) FROM f) AS flagged FROM s)
    SELECT total, eligible, flagged, CASE WHEN total > 0 THEN flagged / total END AS share_of_all, CASE WHEN eligible > 0 THEN flagged / eligible END AS share_of_eligible FROM n""")
def corpus_scan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments a corpus scan sees and flags, and their shares."""
    return _scanned(spark, sf_dir)["rates"]


@query(f"WITH {SCAN_SQL} SELECT segment_id, text, array_to_string(words, ' ') AS words FROM f ORDER BY segment_id LIMIT 45")
def corpus_scan_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segments that a corpus scan flags, as a sample."""
    return _scanned(spark, sf_dir)["samples"].select("segment_id", "text", F.array_join("words", " ").alias("words"))


@query(f"WITH {SCAN_SQL} SELECT segment_id FROM f")
def corpus_scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment that a corpus scan flags."""
    return _scanned(spark, sf_dir)["ids"]


@query("""
    WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+')) AS term FROM benchmark),
    g AS (SELECT DISTINCT term, regexp_extract(term, ' (.*)$', 1) AS translation FROM w),
    f AS (SELECT doc_id, term, contains(lower(text), lower(translation) || '.') AS kept FROM documents, g WHERE contains(lower(text), lower(term)))
    SELECT doc_id, count(*) AS terms, count(*) FILTER (kept) AS kept, min(term) AS first FROM f GROUP BY doc_id""")
def term_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms taken from the benchmark, thousands of them, against all texts: how many a text holds, and how many of those it also ends a sentence with."""
    pairs = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [A-Za-z]+"), F.lit(0)))
    terms = table(spark, sf_dir, "benchmark").select(pairs.alias("term")).distinct().select("term", F.concat(F.regexp_extract("term", " (.*)$", 1), F.lit(".")).alias("translation"))
    checks = evaluation.term_checks(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, "text", "text")
    return checks.groupBy("doc_id").agg(F.count("*").alias("terms"), F.count_if("kept").alias("kept"), F.min("term").alias("first"))
