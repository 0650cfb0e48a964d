"""Accounts, positions and the remaining text rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions import residue as R
from quire.functions import text as X
from quire.functions import titles
from quire.operators import accounts, jobs, limits, reading
from quire.plans.registry import query
from quire.sources.tables import table


@query("""
    WITH u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'g' || c_custkey ELSE 'email:' || c_custkey END AS google_id, c_name || '@x.org' AS email FROM customer),
    i AS (SELECT 'apple' AS provider, 'a' || c_custkey AS provider_id, c_custkey AS user_id FROM customer WHERE c_mktsegment = 'FURNITURE'),
    l AS (SELECT o_orderkey AS login, CASE WHEN o_orderkey % 2 = 0 THEN 'google' ELSE 'apple' END AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'g' ELSE 'a' END || o_custkey AS provider_id,
                 CASE WHEN o_orderkey % 5 > 0 THEN upper('Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || '@x.org') END AS email FROM orders)
    SELECT login, coalesce(u.user_id, i.user_id, m.user_id) AS user_id, CASE WHEN u.user_id IS NOT NULL THEN 'own' WHEN i.user_id IS NOT NULL THEN 'identity' WHEN m.user_id IS NOT NULL THEN 'email' END AS by
    FROM l LEFT JOIN u ON u.google_id = l.provider_id LEFT JOIN i ON i.provider = l.provider AND i.provider_id = l.provider_id LEFT JOIN u m ON lower(m.email) = lower(l.email)""".replace(" AS by\n", " AS \"by\"\n"))
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    users = customer.select(key.alias("user_id"), F.when(key % 3 == 0, F.concat(F.lit("g"), key.cast("string"))).otherwise(F.concat(F.lit("email:"), key.cast("string"))).alias("google_id"), F.concat("c_name", F.lit("@x.org")).alias("email"))
    identities = customer.where("c_mktsegment = 'FURNITURE'").select(F.lit("apple").alias("provider"), F.concat(F.lit("a"), key.cast("string")).alias("provider_id"), key.alias("user_id"))
    even, who = F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")
    logins = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("login"), F.when(even, "google").otherwise("apple").alias("provider"), F.concat(F.when(even, "g").otherwise("a"), who).alias("provider_id"),
        F.when(F.col("o_orderkey") % 5 > 0, F.upper(F.concat(F.lit("Customer#"), F.lpad(who, 9, "0"), F.lit("@x.org")))).alias("email"),
    )
    return accounts.resolved(logins, users, identities).select("login", "user_id", "by")


@query("""
    SELECT a.conv_id, a.turn, coalesce(nullif(CASE WHEN b.turn % 3 = 0 THEN '' ELSE 't: ' || b.text END, ''), a.text) AS shown FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.role <> 'user'""")
def shown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation of a paragraph, or its source where there is none or it is empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    done = rows.where("role <> 'user'").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("t: "), "text")).alias("translated_text"))
    return reading.shown_text(rows, done, ["conv_id", "turn"]).select("conv_id", "turn", "shown")


@query("""
    WITH p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, chr(10) || chr(10) || '+'), lambda x: trim(x) <> '') AS a, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS b FROM documents)
    SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 1 WHEN len(a) > 1 THEN len(a) WHEN len(b) > 1 THEN len(b) ELSE 1 END AS parts FROM p""")
def large_node_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("parts"))


@query("""
    SELECT c_custkey, CASE WHEN NOT (c_acctbal BETWEEN 0 AND 100) THEN 'progress out of range' WHEN c_nationkey < 1 THEN 'chapter below 1' WHEN length(c_name) > 500 THEN 'xpath too long'
        WHEN abs(c_custkey % 60) > 50 OR abs(c_nationkey) > 50 THEN 'coordinate out of range' WHEN length(c_mktsegment) > 60 THEN 'label too long' END AS fault FROM customer""")
def progress_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an update of a reader's progress."""
    fault = numbers.progress_fault(F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_name"), F.col("c_custkey") % 60, F.col("c_nationkey"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", fault.alias("fault"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 1 / 5.3::DOUBLE ELSE least(greatest((p_size % 7)::DOUBLE / p_size, 0.04), 0.35) END AS ratio FROM part")
def spine_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.spine_ratio((F.col("p_size") % 7).cast("double"), F.col("p_size").cast("double")).alias("ratio"))


@query("""
    WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id END AS xp, event_id % 2 AS chapter FROM events),
    r AS (SELECT *, CASE WHEN chapter IS NOT DISTINCT FROM lag(chapter) OVER w THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT event_id, last_value(xp IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS xpath FROM g""")
def local_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position inside a chapter is kept as long as the reader stays there."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(key, "user_id", "ts", (key % 2).alias("chapter"), F.when(key % 3 == 0, F.concat(F.lit("x"), key.cast("string"))).alias("xpath"), F.lit(None).cast("long").alias("ts_ms"))
    return reading.local_saves(rows, "user_id", ["ts", "event_id"]).select("event_id", "xpath")


@query("""
    WITH r AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'cf' WHEN 1 THEN 'other' END AS wish FROM supplier)
    SELECT s_suppkey, CASE WHEN wish = 'cf' THEN 'cf' WHEN wish IS NOT NULL THEN 'railway' WHEN s_nationkey IN (1, 2, 3) THEN 'cf' ELSE 'railway' END AS backend FROM r""")
def job_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit wish, else the list of users, else the default."""
    key = F.col("s_suppkey")
    flag = F.when(key % 3 == 0, jobs.backend(F.lit("cf"))).when(key % 3 == 1, jobs.backend(F.lit("other")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", jobs.routed(flag, F.col("s_nationkey"), [1, 2, 3], F.lit("railway")).alias("backend"))


@query("SELECT event_id, abs(epoch(TIMESTAMP '2024-01-15')::BIGINT - floor(epoch(ts))::BIGINT) <= 86400 AS accepted FROM events")
def signed_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are not too old and not from the future."""
    sent, now = F.col("ts").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", limits.within_tolerance(sent, now, 86_400).alias("accepted"))


@query("""
    WITH e AS (SELECT event_id, event_type AS code, ts FROM events) SELECT event_id, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) = 1 AS won FROM e""")
def consumed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.consumed_once(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), "ts"), "code", ["ts", "event_id"]).select("event_id", "won")


@query("""
    WITH c AS (SELECT event_id AS id, 'u' || user_id AS email, ts AS created_at, ts + INTERVAL 15 DAY AS expires_at, event_id % 8 AS attempts, CASE WHEN event_id % 3 = 0 THEN ts END AS consumed_at FROM events)
    SELECT id, email FROM c WHERE consumed_at IS NULL AND expires_at > TIMESTAMP '2024-01-25' AND attempts < 5 QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) = 1""")
def newest_valid_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    codes = table(spark, sf_dir, "events").select(
        key.alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 15 DAY")).alias("expires_at"),
        (key % 8).alias("attempts"), F.when(key % 3 == 0, F.col("ts")).alias("consumed_at"),
    )
    return limits.valid_code(codes, F.lit("2024-01-25").cast("timestamp_ntz")).select("id", "email")


@query("SELECT doc_id, contains(text, 'the') AS accepted FROM documents")
def repair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repaired text is taken if it leaves fewer words and is not much shorter."""
    before = F.when(F.contains("text", F.lit("the")), F.array(F.lit("the"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    taken = R.accepts_repair(before, F.array(F.lit("a")), F.col("text"), F.substring(F.col("text"), F.lit(1), F.ceil(F.length("text") * 0.7).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", taken.alias("accepted"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS usable FROM part")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a proposed title may stand for the catalogue's: here every second one would lose its script."""
    candidate = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("书")
    return table(spark, sf_dir, "part").select("p_partkey", titles.usable_title(F.col("p_name"), F.col("p_name"), candidate).alias("usable"))


@query("""SELECT item_id, regexp_replace(text, '(?i)de', '<mark>\\0</mark>', 'g') AS marked, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short,
          NOT (regexp_matches(text, '^[“”"''‘「『〈《（(]') OR regexp_matches(text, '[。？！?!]')) AS heading_like FROM benchmark""")
def marked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", X.highlight(text, "de").alias("marked"), X.truncate(text, 80).alias("short"), X.is_heading_like(text).alias("heading_like"))
