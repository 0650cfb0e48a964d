"""Decontamination, conversation trie and centroid clustering against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import centroids, decontamination, prefix_trie

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# -- 11 ----------------------------------------------------------------------------------------------------------


def brute_hits(docs, items, window):
    windows = {}
    for i, text in items:
        w = words(text)
        grams = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []
        for g in grams:
            windows.setdefault(g, set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def passages(seed):
    rnd, vocabulary = random.Random(seed), ["a", "b", "É", "c1", "不", "A"]
    items = [(i if i % 7 else None, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 2, 3, 5, 8, 12, 20])))) for i in range(25)] + [(3, "a b-c1."), (5, None), (5, ""), (6, "zz")]
    docs = [(i, rnd.choice([" ", "-", "\n", "  "]) + " ".join(rnd.choices([*vocabulary, "zy", "zz", "zy"], k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(60)]
    return docs + [(None, None), (1, ""), (1, "x"), (1, "x"), (2, "a b É " * 3000)], items


@pytest.mark.parametrize("window, few, part, piece", [(4, 24, 250_000, 4096), (10, 0, 250_000, 4096), (10, 1 << 30, 40, 7)])
def test_hits_against_brute_force(spark, monkeypatch, window, few, part, piece):
    """Streams side by side and one by one; one part, and several groups of parts of cut items."""
    monkeypatch.setattr(decontamination, "FEW", few)
    monkeypatch.setattr(decontamination, "PART_WORDS", part)
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "PARTS_AT_ONCE", 2)
    docs, items = passages(window)
    got = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", window)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items, window)


def test_no_items(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    got = decontamination.report(docs, "doc_id", "text", items, "item_id", "text").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(2, 0, 0, False), (0, 0, 0, False)]


def test_spans_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Éa {item.upper()}! b" + " c" * 20), (2, item), (3, None), (4, "eleven ten nine"), (5, "")]
    names = "`do.c` long, text string, row string, spans string, items string, n_words string, `a``b` string"
    docs = spark.createDataFrame([(i, t, "r", "s", "i", "n", "q") for i, t in rows], names)
    got = decontamination.decontaminated(docs, "text", spark.createDataFrame([(9, item)], "item_id long, text string"), "item_id", "text")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, t, "r", "s", "i", "n", "q") for i, t in [(1, "Éa ! b" + " c" * 20), (3, None), (4, "eleven ten nine"), (5, "")]]


def test_longest_matches():
    """Every state's run is the longest suffix of what was read that some item holds."""
    rnd = random.Random(5)
    for _ in range(60):
        items = [np.array(rnd.choices(range(1, 5), k=rnd.randint(1, 12)), np.uint64) for _ in range(4)]
        a = decontamination.Automaton([(str(i), x) for i, x in enumerate(items)], 3)
        text = np.array(rnd.choices(range(1, 7), k=80), np.uint64)
        known = a.known(text)
        held = {tuple(x[i:j].tolist()) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        begin = np.flatnonzero((known >= 0) & (np.concatenate([[-1], known[:-1]]) < 0))
        end = np.flatnonzero((known >= 0) & (np.concatenate([known[1:], [-1]]) < 0)) + 1
        _, runs = a.stream(np.maximum(known, 0), begin, end)
        for b, e in zip(begin, end):
            for i in range(b, e):
                assert runs[i] == max((n for n in range(1, i - b + 2) if tuple(text[i - n + 1 : i + 1].tolist()) in held), default=0)


# -- 12 ----------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    digest = lambda z: hashlib.md5(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()
    turns = {c: [z[1:] for z in sorted(own, key=lambda z: (z[0], digest(z)))] for c, own in turns.items()}
    rebuilt = {c: tuple(turns.get(c - int(math.fmod(c, 100)), [])[: zlib.crc32(str(c).encode()) % 6] + own[zlib.crc32(str(c).encode()) % 6 :]) for c, own in turns.items()}
    return rebuilt, brute_nodes(rebuilt)


def brute_nodes(rebuilt):
    members = collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    """Null and equal turns, null roles and texts, missing bases, negative ids, repeated rows, clashing names."""
    rnd = random.Random(seed)
    ids = [-150, -5, 0, 3, 7, 100, 101, 150, 205, 299, 300, 10**12, 10**12 + 1, None]
    rows = [(rnd.choice(ids), rnd.choice([None, 0, 1, 2, 3, 3]), rnd.choice([None, "u", "a"]), rnd.choice([None, "", "a", "é😀b"])) for _ in range(120)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn int, role string, text string, conv string, depth string")
    got = prefix_trie.conversation_trie(frame, "conv_id", "turn", "role", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)[1]


def test_copies_and_deep_prefixes(spark, monkeypatch):
    """Large groups of copies retire at once; classes are split without a broadcast too; a turnless conversation is a member of the root alone."""
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    talks = {c: (("u", "hi"), ("a", "yo" * 3)) for c in range(40)} | {100: (), 101: (("u", "hi"),), 102: (("u", "hi"), ("a", "yo" * 3), ("u", "more")), 103: (("a", ""),) * 4}
    rows = [(c, p, hashlib.md5(repr(z).encode()).digest(), len(z[1]), sum(len(x[1]) for x in s[p:])) for c, s in talks.items() for p, z in enumerate(s)]
    turns = spark.createDataFrame([(c, p, bytearray(d), n, r) for c, p, d, n, r in rows], "conv long, pos long, digest binary, chars long, rest long")
    convs = spark.createDataFrame([(c, len(s)) for c, s in talks.items()], "conv long, len long")
    nodes = prefix_trie.trie(turns, convs)
    assert sorted(map(tuple, nodes.collect()), key=repr) == brute_nodes(talks)
    named = prefix_trie.with_turns(nodes, turns.withColumn("said", F.col("chars")), "said").where("depth = 3 and conv_id = 102").first()
    assert named.said == 4 and named.parent_conv_id == 0
    alone = prefix_trie.trie(turns.where("conv = 103"), convs.where("conv = 103"))
    assert sorted(map(tuple, alone.collect()), key=repr) == brute_nodes({103: talks[103]})


# -- 13 ----------------------------------------------------------------------------------------------------------


def brute_clusters(rows, width, scale, k, seed, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            if of := [v for (_, v), c in zip(kept, own) if c == j]:
                at[j] = [sum(x) // len(of) for x in zip(*of)]
    last = [near(v) for _, v in kept]
    each = collections.Counter()
    for d, c in last:
        each[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, each[c], sum(each.values()), name[c]) for (i, _), (d, c) in zip(kept, last)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_clusters_against_brute_force(spark, k):
    """Many ties and repeated vectors, vectors that take no part, components beyond 27 bits, fewer vectors than clusters."""
    rnd = random.Random(k)
    rows = [(i, rnd.choices([0.0, 0.5, -0.5, 1.0], k=4)) for i in range(200)] + [(1, [0.5] * 4), (None, [0.1] * 4), (10, [1e6, -1e6, 3e5, 0.0]), (11, [1e6] * 4)]
    odd = [(5, None), (6, [1.0] * 3), (7, [None] * 4), (8, [float("nan")] * 4), (9, [float("inf")] * 4), (12, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, e array<double>, cluster string")
    got = centroids.centroid_clusters(frame, "vec_id", "e", 4, 256, k, 2, 5)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == brute_clusters(rows + odd, 4, 256, k, 2, 5)


def test_no_vector_fits(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id long, e array<double>")
    assert centroids.centroid_clusters(frame, "vec_id", "e", 4, 256, 3, 2, 5).count() == 0


def test_distances_beyond_a_long_are_null(spark):
    frame = spark.createDataFrame([(i, [x]) for i, x in enumerate((1e9, -1e9, 4e9, -4e9, 1e300))], "vec_id long, e array<double>")
    got = centroids.centroid_clusters(frame, "vec_id", "e", 1, 4, 1, 2, 0)
    assert got.count() == 4 and any(r.distance is None for r in got.collect())


def test_bounds_spare_scans():
    """Round by round the bounds give the clusters of a full scan, and in later rounds of clustered vectors they spare most of it."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 400
    v = np.rint(middle[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 40).astype(np.int64)
    at, old = [row.tolist() for row in v[:12]], None
    cluster, upper, lower = np.full(3000, -1, np.int32), np.zeros(3000), np.zeros(3000)
    looked = []
    for _ in range(8):
        c = centroids.Centroids(at, old)
        cluster, upper, lower, n = c.assign(v, cluster, upper, lower)
        looked.append(n)
        exact, distance, second = c.scan(v)
        assert (cluster == exact).all() and (upper >= np.sqrt(distance)).all() and (lower <= second + 1e-6).all()
        at, old = [[int(s) // int((cluster == j).sum()) for s in v[cluster == j].sum(axis=0)] if (cluster == j).any() else at[j] for j in range(12)], at
    assert looked[0] == 3000 and looked[-1] < 600


def test_words_of_batches():
    """Words end at the end of a text and of a slice."""
    texts = ["Ab c", None, "", "d", "é1-É", " x ", "y"]
    w = decontamination.Words(pa.array(["zz", *texts]).slice(1))
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    assert w.hash[3] != w.hash[4] and w.hash[0] == decontamination.Words(pa.array(["aB"])).hash[0]
