"""Folds of hot keys in bins, texts through an answering service, the term index, the search index."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation, folds, ledger, limits, reading, routing, search_index, segmentation, terms
from quire.operators.jobs import FAILED_MARK
from quire.plans import routing as stand_in
from quire.staging import folder


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b))
    assert a == b and a


@pytest.fixture
def events(spark):
    rnd = random.Random(8)
    rows = [
        (rnd.choice(["h", "h", "h", None, f"c{rnd.randint(0, 9)}"]), i, rnd.choice([0, 0, 1, 5, 7, 30, 99, 300]), rnd.choice("xyz"), rnd.choice([0.0, 0.0, 1.5, 2.25, 9.0, 30.0]), rnd.randint(0, 5000), "a", "b")
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "k string, i long, n long, g string, w double, t long, hot string, bin string").drop("hot", "bin").cache()


@pytest.fixture
def small_bins(monkeypatch):
    monkeypatch.setattr(segmentation, "BIN_ROWS", 17)


def test_batches_of_a_hot_key(events, small_bins):
    same(folds.batches(events, ["k"], ["i"], "n", 100, hot_rows=50), folds.batches(events, ["k"], ["i"], "n", 100))


@pytest.mark.parametrize("gap", [0.0, 0.5])
def test_packing_of_a_hot_key(events, small_bins, gap):
    same(folds.packed(events, ["k"], "g", ["i"], "w", 20.0, gap, hot_rows=50), folds.packed(events, ["k"], "g", ["i"], "w", 20.0, gap))


@pytest.mark.parametrize("gap", [3, 2000])
def test_throttling_of_a_hot_key(events, small_bins, gap):
    once = limits.throttled(events, "k", "t", "i", gap, hot_rows=50)
    same(once, limits.throttled(events, "k", "t", "i", gap))
    same(once, limits.sliding_window(events, "k", "t", "i", gap, 1).where("not limited").drop("limited", "current"))


def test_a_hot_key_takes_many_tasks(events, small_bins, monkeypatch):
    """The rows of one key are dealt over many bins, and a bin's map is a few steps however many rows it has."""
    made = segmentation.Rule(lambda n: (n.cumsum(), n.cumsum() - n, int(n.sum())), 100)
    rng = np.random.default_rng(1)
    n = rng.integers(1, 30, 100_000)
    step = made.steps(n)
    assert len(step["last"]) < 100 and step["total"] == n.sum()
    for state in (None, 0, 37, 100):
        full, opened = state, 0
        for x in n.tolist():
            full, opened = (x, opened + 1) if full is None or full + x > 100 else (full + x, opened)
        assert made.passed(state, step) == (full, opened)


# -- answers ----------------------------------------------------------------------------------------------------


def py_told(t):
    return t if len(t) % 5 == 0 else t.upper()


def py_left(t):
    return re.findall("[a-z]{3,}", t)


def py_alone(t):
    if len(t) % 7 == 0:
        return None
    first, again = py_told(t), t.upper() if len(t) % 2 == 0 else py_told(t)
    return again if len(py_left(again)) < len(py_left(first)) else first


def by_hand(rows, budgets):
    """Batches by a loop, answers text by text."""
    out, frontier = {}, [r for r in rows if (r[2] or "").strip()]
    out.update({(k, t): ("", "blank", 1) for k, t, x in rows if not (x or "").strip()})
    for n, budget in enumerate(budgets, 1):
        dealt = {}
        for k, t, x in sorted(frontier):
            size, own = -(-len(x) // 4), dealt.setdefault(k, [])
            if own and own[-1][0] + size <= budget:
                own[-1] = (own[-1][0] + size, own[-1][1] + [(t, x)])
            else:
                own.append((size, [(t, x)]))
        frontier = []
        for k, own in dealt.items():
            for _, batch in own:
                sent = "\n".join(f'<seg id="{i}">{x}</seg>' for i, (_, x) in enumerate(batch, 1))
                for i, (t, x) in enumerate(batch, 1):
                    if len(batch) == 1:
                        got, route = py_alone(x), "single"
                    else:
                        got, route = (None if len(sent) % 11 == 0 or i % 3 == 0 or py_left(py_told(x)) else py_told(x)), "batch"
                    if got is None:
                        frontier.append((k, t, x))
                    else:
                        out[k, t] = (got, route, n)
    for k, t, x in frontier:
        got = py_alone(x)
        out[k, t] = (FAILED_MARK, "marker", len(budgets) + 1) if got is None else (got, "retry", len(budgets) + 1)
    return out


def turns():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9)))
    return [(k, t, rnd.choice([None, "", " "]) if rnd.random() < 0.05 else " ".join(word() for _ in range(rnd.randint(1, 40)))) for k in range(6) for t in range(40)]


def test_routes_against_a_loop(spark):
    rows, budgets = turns(), [60, 30]
    got = routing.translated(spark.createDataFrame(rows, "k int, t int, x string"), ["k"], ["t"], "x", budgets, stand_in.batch, stand_in.alone, stand_in.residue, folder(spark))
    found = {(r.k, r.t): (r.translated, r.route, r.attempt) for r in got.collect()}
    assert found == by_hand(rows, budgets) and got.count() == len(rows)
    assert {r for _, r, _ in found.values()} == {"blank", "batch", "single", "retry", "marker"}


def test_a_run_goes_on_half_way(spark):
    """The driver is lost while the second attempt is being written: what is whole is not asked for again, what is half written is made anew."""
    rows, path = turns(), folder(spark)
    frame = spark.createDataFrame(rows, "k int, t int, x string")
    calls = []

    def lost(sent):
        calls.append(1)
        return stand_in.batch(sent) if len(calls) == 1 else F.raise_error(F.lit("lost")).cast("string")

    with pytest.raises(Exception, match="lost"):
        routing.translated(frame, ["k"], ["t"], "x", [60, 30], lost, stand_in.alone, stand_in.residue, path)
    first = sorted(map(tuple, spark.read.parquet(f"{path}/attempt=1").collect()), key=repr)
    asked = []

    def again(sent):
        asked.append(1)
        return stand_in.batch(sent)

    got = routing.translated(frame, ["k"], ["t"], "x", [60, 30], again, stand_in.alone, stand_in.residue, path)
    assert {(r.k, r.t): (r.translated, r.route, r.attempt) for r in got.collect()} == by_hand(rows, [60, 30])
    assert len(asked) == 1 and sorted(map(tuple, spark.read.parquet(f"{path}/attempt=1").collect()), key=repr) == first
    routing.translated(frame, ["k"], ["t"], "x", [60, 30], lambda s: F.raise_error(F.lit("asked")).cast("string"), lambda t, n: F.raise_error(F.lit("asked")).cast("string"), stand_in.residue, path)


# -- terms ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [500_000, 7])
def test_terms_against_contains(spark, monkeypatch, at_once):
    """Terms of all lengths that overlap, begin alike or end texts, empty and null ones, repeated terms, several passes."""
    monkeypatch.setattr(terms, "TERMS_AT_ONCE", at_once)
    rnd = random.Random(at_once)
    make = lambda n: "".join(rnd.choices("aAbÉ 不😀", k=n))
    glossary = [(make(rnd.choice([1, 2, 3, 4, 5, 7, 8, 9, 12])), f"t{i}") for i in range(60)] + [("", "empty"), (None, "null"), ("aB", "x"), ("aB", "x")]
    texts = [(i, make(rnd.choice([0, 1, 3, 20, 200]))) for i in range(40)] + [(None, None), (41, glossary[0][0])]
    rows = spark.createDataFrame(texts, "i int, text string")
    got = evaluation.term_checks(rows, spark.createDataFrame(glossary, "term string, translation string"), "text", "text")
    want = [(i, x, g, t, t.lower() in x.lower()) for i, x in texts if x is not None for g, t in glossary if g is not None and g.lower() in x.lower()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_many_terms_without_a_nested_loop(spark):
    """200 000 terms: no nested loop and no product in the plan, and each text finds the terms it was made of."""
    glossary = spark.range(200_000).select(F.concat(F.lit("Name "), F.hex(F.xxhash64("id"))).alias("term"), F.lit("-").alias("translation"), "id")
    texts = spark.range(0, 200_000, 1000).select(F.col("id").alias("of"), F.concat(F.lit("… xname "), F.hex(F.xxhash64("id")), F.lit("!")).alias("text"))
    got = evaluation.term_checks(texts, glossary.select("term", "translation"), "text", "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 200 and got.where(~F.endswith(F.col("text"), F.concat(F.substring("term", 6, 99), F.lit("!")))).count() == 0


def test_hits_do_not_look_at_their_texts_again(spark):
    """Terms and translations that look alike, in one column and in two; no hit passes or lowers a whole text."""
    glossary = [("Dog", "hund"), ("dog", "HUND"), ("hot dog", "wurst"), ("", "wurst"), ("cat", ""), ("dog", None), ("İx", "é"), ("a" * 40, "😀"), (None, "hund")]
    texts = [(1, "A hot DOG, é", "Wurst"), (2, "dog hund cat", None), (3, None, "hund"), (4, "i̇x İX " + "a" * 41 + "😀", "É hund"), (5, "", "")]
    rows, terms_ = spark.createDataFrame(texts, "i int, text string, other string"), spark.createDataFrame(glossary, "term string, translation string")
    for target in ("text", "other"):
        got = evaluation.term_checks(rows, terms_, "text", target)
        want = rows.crossJoin(terms_).where("contains(lower(text), lower(term))").selectExpr("*", f"contains(lower({target}), lower(translation)) AS kept")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.columns == want.columns
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Contains(" not in plan and "Contains" not in plan.replace("array_contains", "")


# -- search -----------------------------------------------------------------------------------------------------


def test_search_by_postings(spark):
    """The hits of a scan; a rare query reads few of the index's ranges."""
    rnd = random.Random(2)
    texts = [(i % 3, i, " ".join(rnd.choices(["The", "quick", "brown", "É不é", "fox", "jump%", "s"], k=rnd.randint(0, 9))), rnd.choice([None, "", "des RENARDS", "x😀yz"])) for i in range(400)]
    texts[123] = (0, 123, "a needle here", None)
    rows = spark.createDataFrame(texts, "lang int, i int, original_text string, translated_text string")
    path = folder(spark)
    search_index.build(rows, ["original_text", "translated_text"], ["i"], path, parts=16)
    for query in ("quick brown", "the", "renard", "p%", "😀yz", "é不é", "jump% s", "NEEDLE", "absent", "  ", "fox"):
        a = reading.search(rows, query, ["lang"], ["i"], 20, 5 if query == "the" else 0).collect()
        b = search_index.search(spark, path, query, ["lang"], ["i"], 20, 5 if query == "the" else 0).select(*rows.columns, "rank", "has_more", "snippet", "field").collect()
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
    read = lambda q: search_index.candidates(spark, path, q).select("part").distinct().count()
    assert read("needle") == 1 and read("the") == 16
    plan = search_index.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


# -- folds from guesses -----------------------------------------------------------------------------------------


@pytest.fixture
def rounds(monkeypatch):
    """How many rounds the folds take from now on: they write two tables in each."""
    from quire.operators import speculation

    written = []
    monkeypatch.setattr(speculation, "staged", lambda df, own=speculation.staged: written.append(1) or own(df))
    return lambda: len(written) // 2


@pytest.mark.parametrize("low, high", [(-250, 150), (-100, 300), (-30, 0)])
def test_guarded_ledger_of_a_hot_key(spark, small_bins, low, high):
    """Refusals everywhere, hardly any, and after the balance is used up, in bins too small for guesses to be forgotten."""
    rnd = random.Random(low)
    rows = spark.createDataFrame([(rnd.choice(["h", "h", None, "c"]), i, rnd.randint(low, high)) for i in range(300)], "u string, i long, n long")
    same(ledger.guarded(rows, "u", ["i"], "n", hot_rows=100), ledger.guarded(rows, "u", ["i"], "n"))


@pytest.mark.parametrize("window, limit", [(60, 3), (5, 1)])
def test_sliding_window_of_a_hot_key(events, small_bins, window, limit):
    same(limits.sliding_window(events, "k", "t", "i", window, limit, hot_rows=100), limits.sliding_window(events, "k", "t", "i", window, limit))


def test_guesses_are_forgotten(spark, monkeypatch, rounds):
    """In bins of some thousand rows, two or three rounds settle a ledger with refusals, one without any, and a window."""
    monkeypatch.setattr(segmentation, "BIN_ROWS", 15_000)
    h = F.xxhash64("id")
    rows = spark.range(60_000).select(F.lit("h").alias("u"), F.col("id").alias("i"), (F.pmod(h, F.lit(401)) - 250).alias("n"), (F.pmod(h, F.lit(9)) + 5 * F.col("id")).alias("t"))
    same(ledger.guarded(rows, "u", ["i"], "n", hot_rows=100), ledger.guarded(rows, "u", ["i"], "n"))
    first = rounds()
    same(ledger.guarded(rows, "u", ["i"], "t", hot_rows=100), ledger.guarded(rows, "u", ["i"], "t"))
    second = rounds() - first
    same(limits.sliding_window(rows, "u", "t", "i", 60, 3, hot_rows=100), limits.sliding_window(rows, "u", "t", "i", 60, 3))
    assert first <= 3 and second <= 2 and rounds() - first - second <= 3
