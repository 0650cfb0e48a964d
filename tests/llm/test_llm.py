import collections
import gzip
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same, views
from quire.llm import vectors as V
from quire.llm import ann_forest, bpe_tree, jaccard, kd_search, line_dedup, lm, mixing, quality, queries, text_hash, token_counts, warc

FOLDER = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, row string, node string, members string"
ODD = ["", None, " \t\n", "one", "one two", "a b c a b c", "É\x1cñ ǅ ﬁ\xa0x\x85y", "<|endoftext|> a <|startoftext|>", "中文字" * 50, "x" * 3000, "the quick brown fox " * 400, "’s 's 12345 !!\n\n  z"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "s", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    same(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").where("false").write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


# -- 1 -----------------------------------------------------------------------------------------------------------


def test_quality_agrees_with_labels(spark, con):
    got = {r.doc_id: r.keep for r in queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = views("/root/testdata/sf0.01").sql("SELECT doc_id, quality FROM labels").fetchall()
    assert sum(got[d] == bool(q) for d, q in labels) / len(labels) > 0.97


def test_quality_odd_rows(spark):
    rows = docs(spark, ODD + ["spam! spam! " * 50], [None, *range(1, len(ODD)), 7])
    model = quality.fit(rows, "text")
    got = quality.score(rows, "doc_id", "text", model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert not next(r.keep for r in got if r.doc_id is None)


def test_quality_gives_one_row_a_document(spark):
    rows = spark.createDataFrame([(i, f"some words of text {i}") for i in range(1100)], "doc_id long, text string").coalesce(1)
    model = quality.fit(rows, "text")
    got = [r.doc_id for r in quality.score(rows, "doc_id", "text", model).collect()]
    assert sorted(got) == list(range(1100))
    votes = quality._rows(rows.select("text"), "text", lambda t: (quality.votes(quality.measures(t)),), "votes string", pa.schema([("votes", pa.string())]))
    assert votes.count() == 1100


def test_quality_model_does_not_depend_on_batches(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["the", "of", "house", "Tree", "in", "and", "spam!", "WIN", "||"], k=rnd.randint(0, 60))) for _ in range(700)] + [None] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    one, many = (quality.fit(df, "text") for df in (rows.coalesce(1), rows.repartition(7)))
    assert one["posterior"] == pytest.approx(many["posterior"]) and one["share"] == pytest.approx(many["share"]) and np.allclose(one["w"], many["w"])
    got = collections.Counter(r.text for r in quality.kept(rows.coalesce(1), "text", one).collect())
    score = {r.text: r.keep for r in quality.score(rows.withColumn("id", F.col("text")), "id", "text", one).select(F.col("id").alias("text"), "keep").collect()}
    assert got == collections.Counter(t for t in texts if score[t])


def test_em_by_documents():
    """The estimates from vote patterns are those of the same rule run over every single document's votes."""
    rnd = random.Random(12)
    n = len(quality.LABELLERS)
    votes = ["".join(rnd.choice("11110-") if rnd.random() < 0.7 else rnd.choice("0001-") for _ in range(n)) for _ in range(400)]
    posterior, share, rates = quality.em(collections.Counter(votes), rounds=8)

    def start(v):
        fit, unfit = v.count("1"), v.count("0")
        return min(0.95, max(0.05, (fit + 1 - 1.5 * (unfit > 0)) / (fit + unfit + 1) if unfit < 2 else 0.05))

    p = [start(v) for v in votes]
    for _ in range(8):
        fit = sum(p)
        own = [{x: ((1 + sum(1 - q for q, v in zip(p, votes) if v[k] == x)) / (len(votes) - fit + 3), (1 + sum(q for q, v in zip(p, votes) if v[k] == x)) / (fit + 3)) for x in "01-"} for k in range(n)]
        prior = fit / len(votes)
        odds = [prior / (1 - prior) * math.prod(own[k][x][1] / own[k][x][0] for k, x in enumerate(v) if x != "-") for v in votes]
        p = [o / (1 + o) for o in odds]
    assert share == pytest.approx(prior) and all(rates[k][x] == pytest.approx(own[k][x]) for k in range(n) for x in "01-")
    assert all(posterior[v] == pytest.approx(q, abs=1e-9) for v, q in zip(votes, p))


def test_em_finds_the_bad_labeller():
    random.seed(4)
    counts = collections.Counter()
    for _ in range(4000):
        fit = random.random() < 0.8
        v = [random.choice("01-")] + [("1" if fit else "0") if random.random() < 0.9 else ("0" if fit else "1") for _ in range(len(quality.LABELLERS) - 1)]
        counts["".join(v)] += 1
    _, share, rates = quality.em(counts)
    assert abs(share - 0.8) < 0.03 and rates[1]["1"][1] > 0.85 and abs(rates[0]["1"][1] - rates[0]["1"][0]) < 0.1


# -- 2 and 6 -----------------------------------------------------------------------------------------------------


def vectors(spark, n, width=16, seed=1, scale=1.0):
    x = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32) * scale
    rows = [(i, [float(v) for v in x[i]], "clash", 3) for i in range(n)]
    odd = [(n, None, "c", 1), (n + 1, [float("nan")] * width, "c", 1), (n + 2, [None] * width, "c", 1), (n + 3, [float("inf")] * width, "c", 1), (n + 4, [0.0] * width, "c", 1), (None, rows[0][1], "c", 1), (n + 5, rows[0][1], "c", 1), (0, rows[0][1], "c", 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string, rank int"), rows + odd


def usable(rows, zero):
    return [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


@pytest.mark.parametrize("shard", [300, 8192])
def test_kd_search_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr("quire.llm.vectors.SHARD_ROWS", shard)
    df, rows = vectors(spark, 1000)
    own = [(i, np.floor(1024 * v)) for i, v in usable(rows, True)]
    want = collections.Counter()
    for n, (i, q) in enumerate(own):
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(own) if m != n)[:10]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    got = collections.Counter(tuple(r) for r in kd_search.top_k(df, "vec_id", "embedding", 100, 10).collect())
    assert got == want


def test_clusters_are_not_visited_in_vain(spark, monkeypatch):
    """Shards are cut in space, so a query of one cluster is not sent to the shards of others that can't hold its neighbours."""
    monkeypatch.setattr("quire.llm.vectors.SHARD_ROWS", 200)
    rng, sent = np.random.default_rng(4), []
    x = np.concatenate([rng.normal(c, 0.1, (200, 4)) for c in ((9, 0, 0, 0), (0, 9, 0, 0), (0, 0, 9, 0), (0, 0, 0, 9))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")
    whole = V._visited
    monkeypatch.setattr(V, "_visited", lambda rows, visits, *a: sent.append(visits.count()) or whole(rows, visits, *a))
    got = kd_search.top_k(df, "vec_id", "embedding", 20, 10).collect()
    assert len(got) == 400 and sent[0] == 40 and sent[1] < 20


def test_kd_tree_prunes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (500, 4)) for c in (-50, 0, 50)])
    tree = kd_search.KdTree(points, np.arange(1500), np.arange(1500))
    opened = []
    tree.points = type("Seen", (np.ndarray,), {"__getitem__": lambda self, k: opened.append(k) or np.ndarray.__getitem__(self, k)})(points.shape, points.dtype, np.ascontiguousarray(points[tree.order]))
    q = np.full(4, 1.0)
    ids, s = tree.best(q, tree.bounds(q[None])[0], -1, 5, -np.inf)
    assert sorted(s, reverse=True) == sorted(points @ q, reverse=True)[:5] and len(opened) < len([c for c in tree.child if c[0] < 0])


def test_forest_recall_and_scores(spark):
    """The shipped setting over several shards: recall of at least 0.9, and exact scores."""
    df, rows = vectors(spark, 20_000, 64, 5)
    own = usable(rows, False)
    x, ids = np.array([v for _, v in own]), np.array([i for i, _ in own])
    got = collections.defaultdict(list)
    for r in ann_forest.nearest(df, "vec_id", "embedding", 100, 20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in sorted(got):
        if q == 0:  # there twice
            continue
        s = x @ x[np.flatnonzero(ids == q)[0]]
        best = set(ids[np.lexsort((ids, -np.where(ids == q, -np.inf, s)))[:20]])
        hits, total = hits + len(best & {v for _, v, _ in got[q]}), total + 20
        assert all(abs(score - s[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, score in got[q]) and q not in {v for _, v, _ in got[q]}
    assert total > 3000 and hits / total >= 0.9
    assert sorted(v for _, v, _ in got[0])[0] == 0  # the other row with the query's id


@pytest.mark.parametrize("kind", ["unit", "normal", "lognormal", "outlier", "shifted", "clusters"])
def test_recall_on_a_full_shard(kind):
    """Recall of at least 0.9 by looking at a tenth of a full shard's rows at most, in one and the same run."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((V.SHARD_ROWS, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    outlier = unit.copy()
    outlier[5] *= 10
    clusters = rng.standard_normal((40, 64))[rng.integers(0, 40, len(x))] + 0.3 * x
    x = {"unit": unit, "normal": x, "lognormal": unit * rng.lognormal(0, 1, (len(x), 1)), "outlier": outlier, "shifted": x + 0.5, "clusters": clusters}[kind]
    forest, hits, looked = ann_forest.Forest(x), 0, 0
    asked = rng.choice(len(x), 60, replace=False)
    for q, at in zip(asked, forest.candidates(x[asked])):
        s = x @ x[q]
        s[q] = -np.inf
        hits, looked = hits + len(np.intersect1d(np.argsort(-s)[:20], at)), looked + len(at)
    assert hits / (60 * 20) >= 0.9 and looked / 60 <= 0.1 * len(x) + 1


def test_forest_of_few_rows():
    """Small shards are measured like large ones; one row, or fewer than k, are all looked at."""
    for n in (1, 2, 15, 400):
        points = np.random.default_rng(3).standard_normal((n, 8))
        forest = ann_forest.Forest(points)
        at = next(forest.candidates(points[:1]))
        assert 0 in at and (n > 21 or len(at) == n)
        assert n < 400 or len(at) < 300


@pytest.mark.parametrize("n", [1, 3, 700])
def test_prefixes_by_table(n):
    """Ranges of short prefixes are looked up, not searched, and are those of all strings with the prefix; points count the ranges that a row is in."""
    rng = np.random.default_rng(n)
    points = rng.standard_normal((n, 8))
    points[n // 2 :] = points[0]
    forest, codes = ann_forest.Forest(points), ann_forest.hashes(np.concatenate([points[:20], rng.standard_normal((20, 8))]))
    strings, want = forest.codes, np.zeros((codes.shape[1], n), dtype=int)
    for level in range(1, forest.deepest + 1):
        forest.codes = strings if level > n.bit_length() else None
        first, size = forest.ranges(codes, level)
        same = strings[:, None] >> (ann_forest.BITS - level) == codes[:, :, None] >> (ann_forest.BITS - level)
        assert (size == same.sum(axis=2)).all() and (np.where(size > 0, first, 0) == np.where(size > 0, same.argmax(axis=2), 0)).all()
        for q in range(codes.shape[1]):
            np.add.at(want[q], forest.order[same[:, q]], 1)
            got = forest._points(first[:, q] + np.arange(ann_forest.TREES) * n, size[:, q])
            assert got.sum() == size[:, q].sum() and (got == np.bincount(forest.order[same[:, q]], minlength=n)).all()


def test_empty_vectors(spark):
    """An empty vector counts as zeros: it takes part in the exact search, and not in the other."""
    df = spark.createDataFrame([(0, []), (1, [1.0, 2.0]), (2, [-3.0]), (3, None)], "vec_id long, embedding array<double>")
    got = kd_search.top_k(df, "vec_id", "embedding", 2, 5, scale=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0), (0, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, -3)]
    assert {(r.query_id, r.vec_id) for r in ann_forest.nearest(df, "vec_id", "embedding", 1, 5).collect()} == {(1, 2), (2, 1)}
    none = spark.createDataFrame([(0, []), (2, [])], "vec_id long, embedding array<double>")
    assert kd_search.top_k(none, "vec_id", "embedding", 2, 5).count() == 2 and ann_forest.nearest(none, "vec_id", "embedding", 2, 5).count() == 0


def test_cells_hold_all_rows():
    points = np.random.default_rng(5).standard_normal((3000, 6))
    points[:1500] = points[0]
    cells = V.Cells(points[::3], 9)
    of = cells.of(points)
    assert len(set(of)) > 4 and len(set(of[:1500])) == 1 and all(p not in cells.splits for p in of)


# -- 3 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe_tree.load_ranks(P.path(queries.BYTE_BPE))


def test_tree_bpe_equals_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe_tree.TreeBpe(ranks, P.PATTERN)
    rnd = random.Random(9)
    texts = [t for t in ODD if t] + ["".join(rnd.choice("abcdeéñß 's\n\t  1239!?中文\x1c\x85\xa0　") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["".join(rnd.choice(["a", "the", "ing", "x", "aaaa"]) for _ in range(900)) for _ in range(5)]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert ours.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert ours.decode(ids) == t.encode()


def test_join_is_the_monoid_of_encodings(ranks):
    ours, rnd = bpe_tree.TreeBpe(ranks, P.PATTERN), random.Random(2)
    for _ in range(300):
        a, b, c = (bytes(rnd.choice(b"abtheing") for _ in range(rnd.randint(0, 30))) for _ in range(3))
        ea, eb, ec = map(ours.direct, (a, b, c))
        assert ours.join(ours.join(ea, eb), ec) == ours.join(ea, ours.join(eb, ec)) == ours.direct(a + b + c)


def test_unreachable_tokens_are_refused(ranks):
    broken = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        bpe_tree.require_reachable(bpe_tree.TreeBpe(broken, P.PATTERN))


def test_pairs_without_merging_them_again(ranks, monkeypatch):
    """Whether two tokens stay apart is told from the tokens that they are made of, as merging their bytes tells it."""
    ours, rnd = bpe_tree.TreeBpe(ranks, P.PATTERN), random.Random(5)
    tokens = list(ours.token)
    small = [t for t in tokens if len(ours.token[t]) < 4]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)] + [(rnd.choice(small), rnd.choice(small)) for _ in range(6000)]
    want = [ours.direct(ours.token[a] + ours.token[b]) == [a, b] for a, b in pairs]
    assert all(ours.halves(x) for pair in pairs for x in pair) and 500 < sum(want) < 8900
    monkeypatch.setattr(ours, "direct", None)
    assert [ours.stable(a, b) for a, b in pairs] == want
    # abc is made of bc, which has a higher rank: such tokens are merged to tell.
    odd = bpe_tree.TreeBpe({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"cab": 5}, P.PATTERN)
    assert odd.halves(3) is None and odd.halves(4) == (1, 2)
    assert all(odd.stable(a, b) == (odd.direct(odd.token[a] + odd.token[b]) == [a, b]) for a in odd.token for b in odd.token)


def test_bpe_rows(spark):
    rows = bpe_tree.digests(docs(spark, ODD, [None] + [5] * (len(ODD) - 1)), "doc_id", "text", P.path(queries.BYTE_BPE), P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in ODD)
    library = pytest.importorskip("tiktoken").Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree.load_ranks(P.path(queries.BYTE_BPE)), special_tokens={})
    ids = [library.encode_ordinary(t or "") for t in ODD]
    assert sorted((r.n_tokens, r.ids_sha256) for r in rows) == sorted((len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()) for x in ids)
    back = bpe_tree.encode_documents(docs(spark, ODD), "text", ["doc_id"], P.path(queries.BYTE_BPE), P.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(ODD))
    assert {r.doc_id: r.t for r in back.select("doc_id", bpe_tree.decode_ids(F.col("ids"), P.path(queries.BYTE_BPE), P.PATTERN).alias("t")).collect()} == {i: t or "" for i, t in enumerate(ODD)}


# -- 4 -----------------------------------------------------------------------------------------------------------


def test_targets(spark):
    def of(*sizes):
        rows = [(chr(97 + i), n) for i, n in enumerate(sizes)]
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), [1, 2, 3], sum(sizes)).collect()
        return [r.target for r in sorted(got)]

    assert of(100, 100, 100) == [50.0, 100.0, 150.0] and of(10, 1000, 100) == [30.0, 780.0, 300.0] and of(0, 0) == [0.0, 0.0]
    weights, sizes = [1, 2, 3] * 7, [7 * i * i % 101 for i in range(21)]
    capped, level = set(), 0.0
    while True:
        level = (sum(sizes) - sum(3 * sizes[i] for i in capped)) / sum(w for i, w in enumerate(weights) if i not in capped)
        if {i for i in range(21) if 3 * sizes[i] <= level * weights[i]} == capped:
            break
        capped = {i for i in range(21) if 3 * sizes[i] <= level * weights[i]}
    assert of(*sizes) == [min(3.0 * n, level * w) for n, w in zip(sizes, weights)]


def test_plan_comes_from_the_flow(spark, monkeypatch):
    """The amounts of op4 are those of the network: one that takes half as much is followed."""
    docs_ = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(400)], "doc_id long, source string, size long")
    taken = lambda: mixing.mix(docs_, F.array("source"), "doc_id", F.col("size"), [1, 2, 3], 5)[0].agg(F.sum(F.col("__size") * F.col("times"))).first()[0]
    assert abs(taken() - 4000) <= 20
    whole = mixing._flows
    monkeypatch.setattr(mixing, "_flows", lambda *a: whole(*a).withColumn("amount", F.col("amount") / 2))
    assert abs(taken() - 2000) <= 20


def test_flow_is_cheapest():
    random.seed(8)
    for _ in range(25):
        patterns = [(m, random.randint(1, 4)) for m in ((0,), (1,), (0, 1), (1, 2), (2,)) if random.random() < 0.8]
        targets = [float(random.randint(0, 8)) for _ in range(3)]
        got = mixing.min_cost_flow(patterns, targets)
        best = None
        for takes in itertools.product(*[range(3 * s + 1) for _, s in patterns]):
            if any(sum(t for t, (m, _) in zip(takes, patterns) if set(m) <= set(cut)) > sum(targets[i] for i in cut) for n in (1, 2, 3) for cut in itertools.combinations(range(3), n)):
                continue
            cost = sum(sum(min(max(t - k * s, 0), s) * k for k in range(3)) for t, (_, s) in zip(takes, patterns))
            best = min(best or (0, 0), (-sum(takes), cost))
        cost = sum(sum(min(max(t - k * s, 0), s) * k for k in range(3)) for t, (_, s) in zip(got, patterns))
        assert not patterns or (round(-sum(got), 6), round(cost, 6)) == best


def test_mix_among_odd_names(spark):
    rows = spark.createDataFrame([(i, "a b c", "s", 1, "t") for i in range(4)], "`doc.id` long, text string, source string, `x.y` int, `q``r` string")
    mixed, _ = mixing.mix(rows, F.array("source"), "doc.id", mixing.words(F.col("text")), [1], 3)
    got = mixed.select("__row.*", "times")
    assert got.columns == [*rows.columns, "times"] and got.count() == 4


def test_overlapping_sources(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([["a"], ["b"], ["a", "b"], ["b", "c"], [], None, [None]]), rnd.randint(0, 50)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    mixed, plan = mixing.mix(df, F.col("members"), "doc_id", F.col("size"), [1, 2, 3], 5)
    got = {r.doc_id: r.times for r in mixed.select("__row.doc_id", "times").collect()}
    again = {r.doc_id: r.times for r in mixing.mix(df, F.col("members"), "doc_id", F.col("size"), [1, 2, 3], 5)[0].select("__row.doc_id", "times").collect()}
    assert got == again and set(got.values()) <= {0, 1, 2, 3} and len(got) == 800
    assert all(got[i] == 0 for i, m, _ in rows if not m)
    total = sum(s for _, m, s in rows if m)
    assert abs(sum(got[i] * s for i, _, s in rows) - total) < 50 * 5 + 1


# -- 5 -----------------------------------------------------------------------------------------------------------


def test_warc_rows(spark):
    big = "é" * 60
    rows = [(5, big, "u5"), (3, big, None), (3, big, "u3"), (9, "short", "u"), (8, "short", "u"), (None, big, "u"), (7, None, "u"), (6, "", "a\r\nb"), (2, "\x1f\x8b\x08 WARC/1.0" * 30, "u")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, url string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, "page_id", "html", "url").collect()), key=repr)
    of = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    want = [(p, *of(t), *(("revisit", 3) if t == big and p != 3 else ("response", None))) for p, t, _ in rows]
    assert got == sorted(want, key=repr)


def test_reader_is_splittable(spark, tmp_path):
    rnd = random.Random(1)
    payloads = [bytes(rnd.getrandbits(8) for _ in range(rnd.randint(0, 3000))) + warc.MAGIC + b"zz" for _ in range(40)]
    path = tmp_path / "a.warc.gz"
    with open(path, "wb") as out:
        for i, p in enumerate(payloads):
            out.write(gzip.compress(warc._record(i, "u", p, hashlib.sha256(p).hexdigest(), None), rnd.choice([0, 6]), mtime=0))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    files = warc.archives(spark, f"file://{tmp_path}/*.gz")
    for size in (97, 700, 5000, 1 << 20):
        got = sorted(warc.read_records(files, range_bytes=size).select("record_id", "payload").collect())
        assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted((f"<urn:page:{i}>", p) for i, p in enumerate(payloads))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == 40


# -- 7 -----------------------------------------------------------------------------------------------------------


def test_word_hashes():
    texts = ["The  the\tTHE É é", None, "", "x" * 2_000_000 + " x y", "ab ba"]
    w = text_hash.Words(texts)
    words = [x for t in texts for x in (t or "").encode().lower().split()]
    assert len(w.hash) == len(words)
    assert len({(h, x) for h, x in zip(w.hash.tolist(), words)}) == len(set(words)) == len(set(w.hash.tolist()))
    assert (w.last - w.first).tolist() == [len((t or "").split()) for t in texts]


def test_lm_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Der", "die"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))) for _ in range(120)] + ["alpha beta " * 40] * 30 + ODD
    got = lm.score(docs(spark, texts), "doc_id", "text").collect()
    tokens = {i: (t or "").encode().lower().split() + [b"\nend"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_score_by_the_weights(spark):
    """Each score is the sum of log10 probabilities worked out token by token, in plain Python, from the same weights."""
    rnd = random.Random(8)
    vocabulary = [f"{x}{e}" for x in "abcdefgh" for e in ("ing", "ed", "s", "ly", "on")]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40))) for _ in range(150)] + ["unseen words follow"]
    rows = docs(spark, texts)
    got = {r.doc_id: r.score for r in lm.score(rows, "doc_id", "text").collect()}
    counts, vocab, model = lm.fit(rows.where(~lm.is_held_out(F.col("doc_id"))), "text")
    count = {r.word: r.n for r in counts.collect()}
    own = {int(w): (int(s), int(b)) for w, s, b in zip(vocab.words, vocab.slot, vocab.bucket)}
    sizes, shared = vocab.sizes, model.shared

    def log10(scores, outcome):
        return scores[outcome] / math.log(10) - math.log10(sum(map(math.exp, scores)))

    for i, text in enumerate(texts):
        t, b1, b2, total = lm.Tokens([text]), 0, 0, 0.0
        for h, cls, tail in zip(t.hash, t.cls, t.tail):
            slot, bucket = own.get(int(h), (-1, -1))
            mine = lm.Own(sizes, model.rows[b1].astype(float))
            row = int(sizes.pair(np.array([b1]), np.array([b2]))[0])
            total += log10([shared.bias[c] + shared.skip[b2][c] + mine.before[c] + mine.pair[row][c] for c in range(lm.CLASSES)], cls)
            at = slot if slot >= 0 else int(lm.shared_slot(h))
            total += log10([shared.slot[cls][s] + mine.slot[cls][s] for s in range(lm.SLOTS)], at)
            if slot < 0:
                total += math.log10(count.get(int(h.view(np.int64)), 0) + lm.ADD) - vocab.inside[cls, at]
            b1, b2 = (bucket if bucket >= 0 else int(sizes.tail[tail])), b1
        assert got[i] == pytest.approx(total, rel=1e-5)


def test_lm_learns_contexts(spark):
    """Words that follow one another in a fixed order score far above what their counts alone say."""
    cycle = [f"{x}{e}" for x in ("ab", "cd", "ef") for e in ("ing", "ed", "ly", "on")]
    texts = [" ".join(cycle[(i + j) % len(cycle)] for j in range(40)) for i in range(200)]
    got = lm.score(docs(spark, texts), "doc_id", "text").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_lm_odd_ids(spark):
    got = lm.score(docs(spark, ["a b", "a b", None], [1, 1, None]), "doc_id", "text").collect()
    assert len(got) == 3 and [r.held_out for r in got if r.doc_id is None] == [True]


def test_lm_probabilities_sum_to_one():
    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(977)
    cls, n = np.arange(199) % lm.CLASSES, np.arange(1, 200)
    sums = collections.defaultdict(lambda: (0, 0))
    for w, k, m in zip(words, cls, n):
        s = int(lm.shared_slot(w))
        sums[int(k), s] = (sums[int(k), s][0] + int(m), sums[int(k), s][1] + 1)
    vocabulary = lm.Vocabulary(words[100:], cls[100:], n[100:], int(n.sum()), 199, dict(sums))
    sizes, rng = vocabulary.sizes, np.random.default_rng(1)
    width = len(lm.Own(sizes).flat)
    model = lm.Model(sizes, lm.Shared(sizes, rng.normal(0, 1, len(lm.Shared(sizes).flat))), {b: rng.normal(0, 1, width) for b in range(sizes.buckets)})
    p_class = 10 ** model.class_rows(np.array([3 * sizes.buckets + 2]))[0]
    total = 0.0
    own = {int(w): int(vocabulary.slot[i]) for i, w in enumerate(vocabulary.words)}
    for k in range(lm.CLASSES):
        p_slot = 10 ** model.slot_rows(np.array([k * sizes.buckets + 3]))[0]
        used = {own[int(w)] for w, c in zip(words, cls) if c == k and own.get(int(w), -1) >= 0}
        for slot in range(lm.OWN):
            total += p_class[k] * p_slot[slot] * (1 if slot in used else 0)
        idle = sum(p_slot[s] for s in range(lm.OWN) if s not in used)
        total += p_class[k] * idle  # slots that no word has are the only probability that is not given to a word
        for slot in range(lm.OWN, lm.SLOTS):
            inside = [m for w, c, m in zip(words, cls, n) if c == k and int(lm.shared_slot(w)) == slot and own.get(int(w), -1) < 0]
            total += p_class[k] * p_slot[slot] * (sum(m + 0.1 for m in inside) + 0.1) / 10 ** vocabulary.inside[k, slot]
    assert total == pytest.approx(1.0)


# -- 8 -----------------------------------------------------------------------------------------------------------


def brute_classes(texts, ids, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        inter = len(sets[a] & sets[b])
        if inter and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
            parent[root(b)] = root(a)
    names = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            names[root(i)] = min(names.get(root(i), ids[i]), ids[i])
    return sorted(((ids[i], len(sets[i]), names.get(root(i)) if sets[i] else ids[i]) for i in range(len(sets))), key=repr)


@pytest.mark.parametrize("k, num, block, grams, few", [(3, 90, 512, 1 << 20, 1_000_000), (3, 90, 4, 1 << 20, 1_000_000), (5, 80, 512, 300, 0)])
def test_classes_against_brute_force(spark, monkeypatch, k, num, block, grams, few):
    """The second and third case compare families in blocks, by rows and by n-grams, the third joins by shuffles."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GRAMS", grams)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = list(ODD)
    for g in range(6):
        base = rnd.choices(vocabulary, k=rnd.randint(40, 200))
        for _ in range(rnd.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w) if rnd.random() < 0.5 else " ".join(w).upper())
    for _ in range(40):
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(30, 90)) + passage))
    texts += texts[20:26]
    ids = [None if i % 17 == 0 else i // 2 if i % 5 == 0 else i for i in range(len(texts))]
    got = sorted((tuple(r) for r in jaccard.classes(docs(spark, texts, ids), "doc_id", "text", k, num, 100).drop("key").collect()), key=repr)
    assert got == brute_classes(texts, ids, k, num, 100)


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_as_many_tokens_as_they_need(num):
    rng, bands = np.random.default_rng(num), jaccard.Bands(num, 100)
    for n in [*range(2, 60), 100, 300, 1000, 4000]:
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        gone = int(rng.integers(0, n - -(-n * num // 100) + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 64, int(rng.integers(0, 3)), dtype=np.uint64)])
        union = len(np.union1d(a, b))
        if gone + union - n == 0 or 100 * (n - gone) < num * union:
            continue
        row, token, need = jaccard.tokens(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), bands)
        shared = [[t for t in token[row == 0] if t in set(token[row == 1]) and t & 1 == p] for p in (0, 1)]
        needs = [[max(need[(row == r) & (token & 1 == p)], default=0) for r in (0, 1)] for p in (0, 1)]
        assert any(x and len(x) >= max(w) for x, w in zip(shared, needs))


def test_block_product():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 9000)
    sets = [np.sort(rng.choice(base, int(rng.integers(7000, 9000)), replace=False)) for _ in range(12)] + [np.sort(base[:8900]), np.sort(base[:8000])]
    left = rng.random(len(sets)) < 0.6
    got = jaccard.linked_in_block(np.concatenate(sets), np.array([len(s) for s in sets]), left, 90, 100)
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if (left[a] or left[b]) and 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))}
    part = {i: i for i in range(len(sets))}
    for a, b in got:
        assert (min(a, b), max(a, b)) in linked
        part = {i: part[a] if p == part[b] else p for i, p in part.items()}
    assert linked and all(part[a] == part[b] for a, b in linked)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_one_of_each(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "LEFT_OUT", limit)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(3, base), (2, base.upper()), (2, base), (2, base), (5, base + " more"), (None, base), (7, "other words here now then"), (7, "other words here now then"), (8, ""), (8, ""), (9, None), (None, "a b c d e f"), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, __key int")
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in jaccard.one_of_each(df, "doc_id", "text", 5, 80, 100).collect())
    assert got == {(2, base): 1, (7, "other words here now then"): 1, (8, ""): 2, (9, ""): 1, (None, "a b c d e f"): 1}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root(x) == got.get(x, x) for x in parent)


# -- 9 and 10 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lines(spark, monkeypatch, limit):
    """The second case joins the hosts' lines over salted parts instead of a broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    rows = [(i, f"own {i}\n\n Menu \nend", "h1") for i in range(30)] + [(i, f"menu {i}\nMenu", None) for i in range(30, 60)] + [(60, "Menu", "small"), (61, None, "h1"), (61, None, "h1"), (62, "", "h1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, host string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "source", "text").collect()}
    assert got[0] == ("own 0\n", 4, 2) and got[31] == ("menu 31", 2, 1) and got[60] == ("Menu", 1, 0) and got[61] == (None, 0, 0) and got[62] == ("", 1, 0) and len(got) == 63


def test_copies_count_as_one_page(spark):
    """A group of copies that holds a third of a host keeps its text; a line on 2 pages is never boilerplate, one on 3 of 5 is."""
    copy = "first line of the copy\nsecond line of the copy"
    rows = [(copy, "h")] * 30 + [(f"a {i}\n" + ("Shared" if i < 2 else "Menu"), "h") for i in range(60)] + [(f"b {i}\n" + ("Foot" if i < 3 else "x"), "few") for i in range(5)] * 4
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "text string, source string"), "source", "text")
    texts = collections.Counter(r.text for r in got.collect())
    assert texts[copy] == 30 and texts["a 0\nShared"] == 1 and texts["a 5"] == 1 and texts["b 0"] == 4 and texts["b 4\nx"] == 4


def test_lines_among_clashing_names(spark):
    names = ["doc.id", "text", "source", "n_lines", "n_dropped", "bad", "of", "row", "kept", "host", "salt", "__bad"]
    rows = [(i, f"page {i}\nMenu", "s", 9, 9, "b", "o", "r", "k", "h", "t", "u") for i in range(6)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, names), "source", "text")
    assert got.columns == [n for n in names if n not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"page {i}", "s", "b", "o", "r", "k", "h", "t", "u", 2, 1) for i in range(6)]


def test_counts_equal_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path(queries.WORD_BPE))
    texts = ODD + ["ΑΣ ΑΣ. İstanbul don't I'LL é é a1b22!?c " * 3, "a<|endoftext|>b", "x" * 9000]
    got = token_counts.token_counts(docs(spark, texts, [None] + list(range(1, len(texts)))), "doc_id", "text", P.path(queries.WORD_BPE)).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_cache_generations():
    cache = bpe_tree.Recent(3)
    for i in range(10):
        cache.put(i, i)
        assert cache.get(0) == 0
    assert len(cache.young) <= 3 and cache.get(5) is None
