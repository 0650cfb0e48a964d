import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation, folds, jobs, ledger, limits, mutation, reading, sampling, shelf


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("chapters, wanted, actual", [([1, 2, 3], 2, 2), ([1, 2, 42], 43, 42), ([5, 6], 2, 5), ([], 1, None)])
def test_clamp(spark, chapters, wanted, actual):
    asked, own = frame(spark, [(1, wanted)], "book int, wanted int"), frame(spark, [(1, c) for c in chapters], "book int, n int")
    assert reading.nearest_chapter(asked, own, "book", "n", "wanted").first()["actual"] == actual


@pytest.mark.parametrize("lengths, chapter, fraction, percent", [
    ([100, 800, 100], 2, 0.0, 10), ([100, 800, 100], 2, 0.5, 50), ([100, 800, 100], 2, 1.0, 90), ([100, 800, 100], 3, 0.0, 90), ([10, 10, 980], 3, 0.0, 2), ([10, 10, 980], 3, 0.5, 51),
    ([None] * 4, 3, 0.0, 50), ([None] * 4, 3, 0.5, 63), ([0, 0], 2, 0.0, 50), ([500, 0, 500], 2, 1.0, 50), ([100, 100], 1, -0.5, 0), ([100, 100], 2, 1.5, 100),
])
def test_weighted_progress(spark, lengths, chapter, fraction, percent):
    rows = frame(spark, [(1, i + 1, n) for i, n in enumerate(lengths)], "b int, c int, n long")
    assert reading.progress_percent(rows, ["b"], "c", "n", F.lit(fraction)).where(F.col("c") == chapter).first()["percent"] == percent


def test_planning(spark):
    units = frame(spark, [(11, 5), (12, 5), (13, 5), (14, 0)], "id long, expected int")
    rows = frame(spark, [(11,)] * 5 + [(12,)] * 2, "id long")
    plan = jobs.planned(jobs.counted(units, rows, "id"), "expected")
    assert {r.id: r.plan for r in plan.collect()} == {11: "complete", 12: "partial", 13: "pending", 14: "complete"}
    assert jobs.wiped(rows, plan, "id").count() == 5
    assert jobs.finalize(plan.withColumn("b", F.lit(1)), ["b"]).first().fault == "incomplete chapters"


def test_sliding_window():
    second = 1_000_000
    assert limits.admit([0, second, 2 * second], 60 * second, 5)[0] == [False] * 3
    assert limits.admit([0, 1, 2, 3, 61 * second], 60 * second, 3)[0] == [False, False, False, True, False]
    # Refused events do not prolong the block.
    assert limits.admit([0, 59 * second, 60 * second], 60 * second, 1)[0] == [False, True, False]


def test_issuance(spark):
    now = dt.datetime(2024, 1, 2)
    rows = [("k", "i", now - dt.timedelta(minutes=m)) for m in (1, 2, 20, 120)]
    c = limits.issuance_counters(frame(spark, rows, "abuse_key string, ip string, created_at timestamp_ntz"), F.lit(now).cast("timestamp_ntz"), "k", "i")
    assert tuple(c.first()) == (2, 4, 3, 4, 4) and c.select(limits.issuance_answer()).first()[0] == 200
    empty = limits.issuance_counters(frame(spark, [], "abuse_key string, ip string, created_at timestamp_ntz"), F.lit(now).cast("timestamp_ntz"), "k", "i")
    assert tuple(empty.first()) == (0,) * 5


def test_codes(spark):
    now = dt.datetime(2024, 1, 2)
    later, before = now + dt.timedelta(minutes=5), now - dt.timedelta(minutes=5)
    rows = [(1, "e", later, 0, None, before), (2, "e", later, 0, None, now), (3, "e", later, 9, None, now), (4, "e", before, 0, None, now), (5, "e", later, 0, now, now)]
    codes = frame(spark, rows, "id int, email string, expires_at timestamp_ntz, attempts int, consumed_at timestamp_ntz, created_at timestamp_ntz")
    assert [r.id for r in limits.valid_code(codes, F.lit(now).cast("timestamp_ntz")).collect()] == [2]
    assert [r.won for r in limits.consumed_once(codes, "email", ["id"]).orderBy("id").collect()] == [True] + [False] * 4


def test_merge_progress(spark):
    local = frame(spark, [(i, 1, "x", True, 1711285200000) for i in range(1, 6)], "b int, chapter int, xpath string, show_original boolean, ts_ms long")
    cloud = frame(spark, [(1, 5, "", 1, "2024-03-24 13:00:01"), (2, 5, "y", 0, "2024-03-24 13:00:00"), (3, None, "y", 0, "2025-01-01 00:00:00"), (4, 5, "y", 0, None)], "b int, chapter_number int, paragraph_xpath string, show_original int, updated_at string")
    got = {r.b: (r.chapter, r.xpath, r.source) for r in reading.merge_progress(local, cloud, "b").collect()}
    assert got == {1: (5, None, "cloud"), 2: (1, "x", "local"), 3: (1, "x", "local"), 4: (1, "x", "local"), 5: (1, "x", "local")}


def test_search_pages_and_fallback(spark):
    chapters = frame(spark, [(1, 10, 1, "One", 0, None), (2, 20, 1, "Two", 0, '[{"xpath":"/p[1]","text":"plain Words","html":"","orderIndex":0}]')], "book_id int, id int, chapter_number int, chapter_title string, order_index int, text_nodes_json string")
    done = frame(spark, [(10, "/p[1]", "Some words", "einige Wörter", 0), (10, "/p[2]", "other", "WORDS", 1)], "chapter_id int, xpath string, original_text string, translated_text string, order_index int")
    rows = reading.segments(chapters, done)
    hits = {(r.book_id, r.xpath): (r.rank, r.field, r.has_more) for r in reading.search(rows, " words ", ["book_id"], ["chapter_order", "order_index"]).collect()}
    assert hits == {(1, "/p[1]"): (1, "original", False), (1, "/p[2]"): (2, "translated", False), (2, "/p[1]"): (1, "original", False)}
    first = reading.search(rows, "words", ["book_id"], ["chapter_order", "order_index"], limit=1).where("book_id = 1").collect()
    assert len(first) == 1 and first[0].has_more
    assert reading.search(rows, "  ", ["book_id"], ["order_index"]).count() == 0


def test_html_rebuilt(spark):
    rows = frame(spark, [(1, 2, "/body[1]/h2[1]", '<a href="x.html">T</a>'), (1, 1, "/odd", '<a id="q"/>a<a href="https://x.org">l</a>')], "c int, n int, xpath string, html string")
    assert reading.html_of(rows, ["c"], "xpath", ["n"], F.col("html")).first().raw_html == '<p data-xpath="/odd">a<a href="https://x.org">l</a></p>\n<h2 data-xpath="/body[1]/h2[1]">T</h2>'


def test_shelves(spark):
    placed = frame(spark, [(1, 0), (2, 1), (3, 2)], "book_id long, position long")
    assert {r.book_id: r.position for r in shelf.insert_at(placed, 9, 1).collect()} == {1: 0, 9: 1, 2: 2, 3: 3}
    assert {r.book_id: r.position for r in shelf.insert_at(placed, 1, 99).collect()} == {2: 0, 3: 1, 1: 2}
    books = frame(spark, [(0, 0, 1.0, 1.0), (0, 0, 2.5, 1.0)], "row int, col int, x double, width double")
    got = shelf.insert_index(frame(spark, [(1, 2.0, 0.0, 1.0), (2, 2.0, 0.0, 9.0)], "point int, x double, y double, width double"), books, 10.0, 5.0, 4.0)
    assert {r.point: (r.fits, r.insert_index) for r in got.collect()} == {1: (True, 1), 2: (False, 1)}


def test_batches_conserve_rows(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.randint(0, 90)) for k in range(5) for i in range(rnd.randint(1, 40))]
    got = folds.batches(frame(spark, rows, "k int, i int, n long"), ["k"], ["i"], "n", 60).collect()
    assert sorted((r.k, r.i, r.n) for r in got) == sorted(rows)
    for k in range(5):
        own = sorted((r.i, r.batch, r.n) for r in got if r.k == k)
        assert [b for _, b, _ in own] == sorted(b for _, b, _ in own)
        for b in {b for _, b, _ in own}:
            sizes = [n for _, x, n in own if x == b]
            assert sum(sizes) <= 60 or len([n for n in sizes if n]) == 1 or sizes[0] > 60


def test_packing_starts_groups_afresh(spark):
    rows = [(1, "a", 1, 6.0), (1, "a", 2, 6.0), (1, "b", 3, 1.0), (1, "b", 4, 20.0)]
    got = {r.i: (r.shelf_row, r.x) for r in folds.packed(frame(spark, rows, "k int, g string, i int, w double"), ["k"], "g", ["i"], "w", 10.0).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.0), 3: (2, 0.0), 4: (3, 0.0)}


def test_ledger(spark):
    rows = frame(spark, [(1, i, a) for i, a in enumerate((-900, -200, 150, -250))], "u int, i int, a long")
    assert [(r.accepted, r.balance_after) for r in ledger.guarded(rows, "u", ["i"], "a").orderBy("i").collect()] == [(True, 100), (False, 100), (True, 250), (True, 0)]
    paid = frame(spark, [(1, "p"), (2, "p"), (3, None), (4, None)], "i int, p string")
    assert sorted(r.i for r in ledger.once_each(paid, "p", ["i"]).collect()) == [1, 3, 4]


def test_mutations(spark):
    old = frame(spark, [(1, "a", 1), (2, "b", 0)], "k int, x string, s int")
    new = frame(spark, [(2, None, None), (3, "c", 1)], "k int, x string, s int")
    assert sorted(map(tuple, mutation.upsert(old, new, ["k"], ["s"]).collect())) == [(1, "a", 1), (2, None, 0), (3, "c", 1)]
    assert sorted(r.k for r in mutation.insert_ignore(old, new, ["k"]).collect()) == [1, 2, 3]
    once = mutation.replace_by_key(old, new, ["k"])
    assert sorted(map(tuple, mutation.replace_by_key(once, new, ["k"]).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_samples(spark):
    rows = frame(spark, [(1, i) for i in range(10)], "k int, i int")
    assert sorted(r.i for r in sampling.evenly_spaced(rows, ["k"], ["i"], 3).collect()) == [0, 3, 6]
    parts = [(r.part, r.i) for r in sampling.head_middle_tail(rows, ["k"], ["i"], 2, 2, 9).collect()]
    assert ("head", 1) in parts and ("middle", 4) in parts and ("tail", 1) in parts


def test_evaluation(spark):
    rows = frame(spark, [], "m string, translated_text string, words array<string>, checks int, kept int, parsed boolean")
    assert evaluation.metrics(rows, ["m"], F.col("words"), F.col("checks"), F.col("kept")).count() == 0
    layers = [frame(spark, [("a", "1"), ("b", "2")], "term string, translation string"), frame(spark, [("b", "3")], "term string, translation string")]
    assert {r.term: r.translation for r in evaluation.merged_glossary(layers).collect()} == {"a": "1", "b": "3"}


def test_numbers_within_hot_keys(spark):
    from quire.operators import ranks, reading

    rows = [("hot" if i % 4 else None, (i * 7919) % 1009, i, i if i % 50 == 0 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v long, id long, mark long")
    got = {r.id: (r.at, r.n, r.last) for r in ranks.carried(ranks.numbered(df, ["k"], ["v", "id"]), ["k"], ["v", "id"], F.col("mark"), "last").collect()}
    for key in ("hot", None):
        own, last = sorted((v, i, m) for k, v, i, m in rows if k == key), None
        for n, (_, i, m) in enumerate(own):
            last = m if m is not None else last
            assert got[i] == (n, len(own), last)
    assert ranks.numbered(df.where("false"), ["k"], ["v"]).count() == 0
    asked = spark.createDataFrame([(1, 5)] * 3 + [(2, 1)], "book int, wanted int")
    chapters = spark.createDataFrame([(1, 2), (1, 4), (1, 9)], "book int, number int")
    got = reading.nearest_chapter(asked, chapters, "book", "number", "wanted").collect()
    assert sorted((r.book, r.wanted, r.actual) for r in got) == [(1, 5, 4)] * 3 + [(2, 1, None)]
