"""Order-dependent logic: batching, packing, admission, ledgers, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import folds, ledger, limits, mutation, reading
from quire.plans.registry import query
from quire.sources.tables import table


def greedy_sql(size: str, budget: int) -> str:
    """Batches of the conversations' turns by a recursive walk in order."""
    return f"""
    WITH RECURSIVE r AS (SELECT conv_id, turn, {size} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (
        SELECT conv_id, turn, size, k, 1::BIGINT AS batch, size AS batch_size FROM r WHERE k = 1
        UNION ALL
        SELECT r.conv_id, r.turn, r.size, r.k, CASE WHEN f.batch_size + r.size > {budget} THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.batch_size + r.size > {budget} THEN r.size ELSE f.batch_size + r.size END
        FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
    SELECT conv_id, turn, size, batch, batch_size FROM f"""


@query(greedy_sql(f"ceil(length(regexp_replace(text, '[^{X.CJK}]', '', 'g')) / 2 + (length(text) - length(regexp_replace(text, '[^{X.CJK}]', '', 'g'))) / 4)::BIGINT", 200))
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.batch_tokens(F.col("text")).alias("size"))
    return folds.batches(rows, ["conv_id"], ["turn"], "size", 200)


@query(greedy_sql("length(text)::BIGINT", 2000))
def char_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return folds.batches(rows, ["conv_id"], ["turn"], "size", 2000)


@query("""
    WITH RECURSIVE r AS (
        SELECT c_nationkey, c_mktsegment, c_custkey, (c_custkey % 7 + 1)::DOUBLE AS width, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS k FROM customer),
    f AS (
        SELECT *, 0::BIGINT AS shelf_row, 0::DOUBLE AS x FROM r WHERE k = 1
        UNION ALL
        SELECT r.*, CASE WHEN r.c_mktsegment <> f.c_mktsegment OR (f.x + f.width > 0 AND f.x + f.width + r.width > 20 + 1e-6) THEN f.shelf_row + 1 ELSE f.shelf_row END,
               CASE WHEN r.c_mktsegment <> f.c_mktsegment OR (f.x + f.width > 0 AND f.x + f.width + r.width > 20 + 1e-6) THEN 0 ELSE f.x + f.width END
        FROM f JOIN r ON r.c_nationkey = f.c_nationkey AND r.k = f.k + 1)
    SELECT c_custkey, shelf_row, x FROM f""")
def shelf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", (F.col("c_custkey") % 7 + 1).cast("double").alias("width"))
    return folds.packed(rows, ["c_nationkey"], "c_mktsegment", ["c_custkey"], "width", 20.0).select("c_custkey", "shelf_row", "x")


DAY = 86_400_000_000


@query("""
    WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (
        SELECT event_id, user_id, t, k, FALSE AS limited, [t] AS held FROM r WHERE k = 1
        UNION ALL
        SELECT r.event_id, r.user_id, r.t, r.k, len(list_filter(f.held, lambda x: r.t - x < 86400000000)) >= 2,
               CASE WHEN len(list_filter(f.held, lambda x: r.t - x < 86400000000)) >= 2 THEN list_filter(f.held, lambda x: r.t - x < 86400000000) ELSE list_append(list_filter(f.held, lambda x: r.t - x < 86400000000), r.t) END
        FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT event_id, user_id, limited, len(held)::BIGINT AS current FROM f""")
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two accepted events of a user in a day; refused ones do not count."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return limits.sliding_window(rows, "user_id", "t", "event_id", DAY, 2).select("event_id", "user_id", "limited", "current")


@query("""
    WITH RECURSIVE r AS (SELECT event_id, user_id, ((event_id * 37) % 400 - 250)::BIGINT AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (
        SELECT *, amount >= 0 OR 1000 >= -amount AS accepted, CASE WHEN amount >= 0 OR 1000 >= -amount THEN 1000 + amount ELSE 1000 END AS balance_after FROM r WHERE k = 1
        UNION ALL
        SELECT r.*, r.amount >= 0 OR f.balance_after >= -r.amount, CASE WHEN r.amount >= 0 OR f.balance_after >= -r.amount THEN f.balance_after + r.amount ELSE f.balance_after END
        FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT event_id, amount, accepted, balance_after FROM f""")
def guarded_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), ((F.col("event_id") * 37) % 400 - 250).cast("long").alias("amount"))
    return ledger.guarded(rows, "user_id", ["t", "event_id"], "amount").select("event_id", "amount", "accepted", "balance_after")


@query("SELECT event_id, user_id, (1000 + sum(event_id % 50 - 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance_after FROM events")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 50 - 20).alias("amount"))
    return ledger.running_balance(rows, "user_id", ["ts", "event_id"], "amount").select("event_id", "user_id", "balance_after")


@query("""
    WITH c AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN 'pay' || event_id % 3000 END AS payment, ts FROM events)
    SELECT event_id, payment FROM c QUALIFY payment IS NULL OR row_number() OVER (PARTITION BY payment ORDER BY ts, event_id) = 1""")
def credit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of credits for one payment the first counts."""
    payment = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("pay"), (F.col("event_id") % 3000).cast("string")))
    return ledger.once_each(table(spark, sf_dir, "events").select("event_id", payment.alias("payment"), "ts"), "payment", ["ts", "event_id"]).select("event_id", "payment")


@query("""
    SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR following >= ts + INTERVAL 1 HOUR""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.debounced(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"], "1 hour").select("event_id", "user_id")


@query("""
    WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (
        SELECT event_id, user_id, t, k, TRUE AS sent, t AS last FROM r WHERE k = 1
        UNION ALL
        SELECT r.event_id, r.user_id, r.t, r.k, r.t - f.last >= 7200000000, CASE WHEN r.t - f.last >= 7200000000 THEN r.t ELSE f.last END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
    SELECT event_id, user_id FROM f WHERE sent""")
def poll_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return limits.throttled(rows, "user_id", "t", "event_id", 7_200_000_000).select("event_id", "user_id")


@query("SELECT event_id, ts < min(ts) OVER (PARTITION BY user_id) + INTERVAL 2 DAY AS refreshing FROM events")
def refresh_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.first_seen_until(table(spark, sf_dir, "events"), "user_id", "ts", "2 days").select("event_id", "refreshing")


@query("""
    WITH l AS (SELECT c_custkey AS book, (c_custkey % 9 + 1)::BIGINT AS chapter, 'l' || c_custkey AS xpath, epoch_ms(TIMESTAMP '1996-01-01') + c_custkey * 1000000 AS ts_ms FROM customer),
    c AS (SELECT o_custkey AS book, arg_max(o_orderkey % 12, (o_orderdate, o_orderkey)) AS chapter_number, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS xpath, max(epoch_ms(o_orderdate)) AS ms FROM orders GROUP BY 1),
    j AS (SELECT l.*, c.chapter_number, c.xpath AS cx, c.ms, coalesce(c.chapter_number, 0) <> 0 AND c.ms > l.ts_ms AS newer FROM l LEFT JOIN c USING (book))
    SELECT book, CASE WHEN newer THEN chapter_number ELSE chapter END AS chapter, CASE WHEN newer THEN cx ELSE xpath END AS xpath, CASE WHEN newer THEN ms ELSE ts_ms END AS ts_ms, CASE WHEN newer THEN 'cloud' ELSE 'local' END AS source FROM j""")
def progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer of two records; a tie leaves the local one."""
    key = F.col("c_custkey")
    start = F.unix_millis(F.lit("1996-01-01 00:00:00").cast("timestamp"))
    local = table(spark, sf_dir, "customer").select(key.alias("book"), (key % 9 + 1).alias("chapter"), F.concat(F.lit("l"), key.cast("string")).alias("xpath"), F.lit(True).alias("show_original"), (start + key * 1_000_000).alias("ts_ms"))
    at = F.struct("o_orderdate", "o_orderkey")
    cloud = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book")).agg(
        F.max_by(F.col("o_orderkey") % 12, at).alias("chapter_number"), F.max_by("o_orderpriority", at).alias("paragraph_xpath"), F.lit(1).alias("show_original"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("updated_at")
    )
    return reading.merge_progress(local, cloud, "book").select("book", "chapter", "xpath", "ts_ms", "source")


UPSERT_SQL = "d AS (SELECT user_id, arg_max((event_id % 3 > 0)::INTEGER, (ts, event_id)) AS done, max(ts) AS at_ FROM events GROUP BY 1)"


@query(f"""
    WITH {UPSERT_SQL}, o AS (SELECT 2 * c_custkey AS user_id, (c_custkey % 2)::INTEGER AS is_completed, CASE WHEN c_custkey % 2 = 1 THEN TIMESTAMP '2023-12-31' END AS completed_at FROM customer)
    SELECT coalesce(o.user_id, d.user_id) AS user_id, coalesce(d.done, o.is_completed) AS is_completed,
           CASE WHEN d.done IS NULL THEN o.completed_at WHEN d.done = 1 THEN coalesce(o.completed_at, d.at_) END AS completed_at FROM o FULL JOIN d ON o.user_id = d.user_id""")
def upsert_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completion's first time is kept by later ones and cleared when the book is no longer completed."""
    key = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select((2 * key).alias("user_id"), (key % 2).cast("int").alias("is_completed"), F.when(key % 2 == 1, F.lit("2023-12-31").cast("timestamp_ntz")).alias("completed_at"))
    at = F.struct("ts", "event_id")
    changes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by((F.col("event_id") % 3 > 0).cast("int"), at).alias("is_completed"), F.max("ts").alias("at"))
    return mutation.completed(old, changes, ["user_id"])


@query("""
    WITH o AS (SELECT 2 * c_custkey AS user_id, c_name AS xpath, (c_custkey % 2)::INTEGER AS show_original FROM customer),
    n AS (SELECT user_id, arg_max(CASE WHEN event_id % 4 > 0 THEN event_type END, (ts, event_id)) FILTER (TRUE) AS x, max(CASE WHEN event_id % 900 = 0 THEN 0 END)::INTEGER AS s FROM events GROUP BY 1),
    l AS (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS x FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN l.x ELSE o.xpath END AS xpath, CASE WHEN n.user_id IS NOT NULL THEN coalesce(n.s, o.show_original) ELSE o.show_original END AS show_original
    FROM o FULL JOIN n ON o.user_id = n.user_id LEFT JOIN l ON l.user_id = n.user_id""")
def upsert_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change overwrites the position, even with null, and keeps a setting that it does not name."""
    key = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select((2 * key).alias("user_id"), F.col("c_name").alias("xpath"), (key % 2).cast("int").alias("show_original"))
    at = F.struct("ts", "event_id")
    changes = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by(F.struct(F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("x")), at)["x"].alias("xpath"), F.max(F.when(F.col("event_id") % 900 == 0, 0)).alias("show_original")
    )
    return mutation.upsert(old, changes, ["user_id"], keep=["show_original"])


@query("""
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a unique key: the last of each key stays."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_partkey", "l_extendedprice")
    return mutation.latest_by_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the lines when the customers of a nation go, with their orders and lines."""
    tables = {
        "customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders"),
        "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
    }
    doomed = tables["customer"].where("c_nationkey = 3")
    parents = [("customer", "c_custkey", "", ""), ("orders", "o_orderkey", "customer", "o_custkey"), ("lineitem", "l_orderkey", "orders", "l_orderkey")]
    return mutation.delete_cascade(tables, doomed, parents)["lineitem"]


@query("""
    WITH o AS (SELECT c_custkey AS id, c_name AS name FROM customer), n AS (SELECT c_custkey + 5000 AS id, c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT o_orderkey, n.id AS o_custkey FROM orders JOIN o ON o.id = o_custkey LEFT JOIN n ON n.name = o.name""")
def remapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to old ids become references to new ones through natural keys, or null."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    old, new = customers.select("id", "name"), customers.where("c_mktsegment <> 'MACHINERY'").select((F.col("id") + 5000).alias("id"), "name")
    return mutation.remapped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), old, new, "o_custkey", "id", ["name"], required=False)
