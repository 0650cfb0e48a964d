"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection of documents.

Documents are aggregated by the set of sources that they belong to.  The network leads from each pattern, through up to
MAX_TAKES arcs of its size whose cost rises with each repetition, to the patterns' sources, whose quotas are the targets;
the cheapest largest flow says how much of each pattern to take.  Sources that share no documents, also by way of others, have networks of their own, which
tasks solve one by one.  A pattern's amount is whole passes over all its documents and a rest, which goes to the documents that come first in the order of a seeded hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.jaccard import components
from quire.llm.shared import cut, numbered, small

#: Times that a document may be taken; the n-th time costs n - 1 for each word.
MAX_TAKES = 3
#: Hash ranges that the documents of a pattern are summed in to find where the rest ends: 2**12 of them.
RANGE_BITS = 12
HASH_BITS = 60

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """A hash of seed and id as a HASH_BITS-bit number, the same on every run; a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[int], total: int) -> DataFrame:
    """source, source_size, target of ``sources`` (source, source_size): they share ``total`` by weight, none above MAX_TAKES times its size.

    Weights repeat over the sources in the order of code points, null last.  What a source can't take is reshared by weight until none is above; each resharing is
    one aggregate, and ends at ``min(cap, level * weight)``.
    """
    position = numbered(sources, F.col("source").isNull(), F.col("source"))
    weighed = cut(position.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))).withColumn("cap", MAX_TAKES * F.col("source_size")))
    level, full = 0.0, -1
    weight = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    while weight:
        r = weighed.where(F.col("cap") <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if r[0] == full:
            break
        full, level = r[0], (total - r[1]) / (weight - r[2]) if weight > r[2] else float("inf")
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], targets: list[float]) -> list[float]:
    """How many words to take of each pattern (its sources, its size): the largest flow of least repetition cost.

    Successive shortest paths with potentials, for each connected part of the network by itself.
    """
    parent = list(range(len(targets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    parts = defaultdict(list)
    for k, (members, size) in enumerate(patterns):
        if members and size:
            parts[root(members[0])].append(k)
    taken = [0.0] * len(patterns)
    for ks in parts.values():
        _solve(ks, patterns, targets, taken)
    return taken


def _solve(ks: list[int], patterns: list[tuple[tuple[int, ...], int]], targets: list[float], taken: list[float]) -> None:
    sources = sorted({s for k in ks for s in patterns[k][0]})
    at = {s: 2 + len(ks) + n for n, s in enumerate(sources)}
    n = 2 + len(ks) + len(sources)
    head, cap, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(a: int, b: int, c: float, w: float) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0.0, -w)):
            out[x].append(len(head))
            head.append(y)
            cap.append(z)
            cost.append(v)

    for i, k in enumerate(ks):
        for time in range(MAX_TAKES):
            arc(0, 2 + i, float(patterns[k][1]), float(time))
        for s in patterns[k][0]:
            arc(2 + i, at[s], float("inf"), 0.0)
    for s in sources:
        arc(at[s], 1, targets[s], 0.0)
    small = 1e-9 * max(1.0, sum(targets[s] for s in sources))
    price = [0.0] * n
    while True:
        far, via, queue = [float("inf")] * n, [-1] * n, [(0.0, 0)]
        far[0] = 0.0
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] > small and (to := d + cost[e] + price[x] - price[head[e]]) < far[head[e]] - 1e-12:
                    far[head[e]], via[head[e]] = to, e
                    heapq.heappush(queue, (to, head[e]))
        if via[1] < 0:
            break
        price = [p + min(f, far[1]) for p, f in zip(price, far)]
        push, x = float("inf"), 1
        while x:
            push, x = min(push, cap[via[x]]), head[via[x] ^ 1]
        x = 1
        while x:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = head[via[x] ^ 1]
    for i, k in enumerate(ks):
        taken[k] = sum(cap[e ^ 1] for e in out[0] if head[e] == 2 + i)


def _key(of: Column) -> Column:
    """A number for a source, null included."""
    return F.xxhash64(F.to_json(F.array(of)))


def _flows(patterns: DataFrame, told: DataFrame) -> DataFrame:
    """pattern, amount: the words that the flow takes of each of ``patterns`` (pattern, members, size); ``told`` has the sources' targets.

    Networks are told apart by the components of sources that patterns join, and each is solved in a task.
    """
    joined = patterns.where(F.size("members") > 1).select(F.col("members")[0].alias("x"), F.explode("members").alias("y"))
    labels = components(joined.select(_key(F.col("x")).alias("a"), _key(F.col("y")).alias("b")))
    arcs = patterns.select("pattern", "size", F.explode("members").alias("source")).join(told.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
    arcs = arcs.withColumn("node", _key(F.col("source"))).join(labels, "node", "left").select(F.coalesce("label", "node").alias("network"), "node", "target", "pattern", "size")

    def solve(network: pd.DataFrame) -> pd.DataFrame:
        sources = network.groupby("node")["target"].first().sort_index()
        at = {node: i for i, node in enumerate(sources.index)}
        of = {p: (tuple(sorted(at[n] for n in g["node"])), int(g["size"].iloc[0])) for p, g in network.groupby("pattern", sort=True)}
        return pd.DataFrame({"pattern": list(of), "amount": min_cost_flow(list(of.values()), [float(x) for x in sources])})

    return arcs.groupBy("network").applyInPandas(solve, "pattern string, amount double")


def takes(slim: DataFrame, weights: list[int], seed: int) -> DataFrame:
    """For each membership pattern: how often its documents are taken, as ``pattern``, ``passes`` and ``edge``; source_size and target of patterns of one source.

    ``slim`` has ``pattern``, ``members`` array<string>, ``size`` long and ``h``, the seeded hash.  A document is taken ``passes`` times, and once more if its
    hash is at most ``edge``.
    """
    sums = slim.groupBy("pattern", F.shiftright("h", HASH_BITS - RANGE_BITS).alias("range")).agg(F.first("members").alias("members"), F.sum("size").alias("size"))
    sums = cut(sums.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("range"))))
    patterns = cut(sums.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")))
    sources = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    told = cut(targets(sources, weights, patterns.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    flows = _flows(patterns, told).join(patterns, "pattern")
    passes = F.when(F.col("size") > 0, F.least(F.lit(MAX_TAKES), F.floor(F.col("amount") / F.col("size")))).otherwise(0)
    rest = F.when(F.col("passes") < MAX_TAKES, F.col("amount") - F.col("passes") * F.col("size")).otherwise(0.0)
    one = F.when(F.size("members") == 1, F.array(F.col("members")[0]))
    chosen = flows.withColumn("passes", passes).withColumn("rest", rest).withColumn("one", one).join(told, F.col("one").eqNullSafe(F.array("source")), "left")
    chosen = cut(chosen.select("pattern", "passes", "rest", "source_size", "target"))
    # The range in which the rest ends, then the exact hash: the document at the edge is taken if that comes nearer to the target.
    ends = sums.join(small(chosen), "pattern").where((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    ends = cut(ends.select("pattern", F.col("range").alias("last"), (F.col("rest") - F.col("upto") + F.col("size")).alias("left")))
    near = slim.select("pattern", F.shiftright("h", HASH_BITS - RANGE_BITS).alias("last"), "h", "size").join(small(ends), ["pattern", "last"])
    near = near.groupBy("pattern", "left", "h").agg(F.sum("size").alias("size"))
    upto = near.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("h")))
    inside = upto.where(2 * F.col("upto") - F.col("size") <= 2 * F.col("left")).groupBy("pattern").agg(F.max("h").alias("inside"))
    edges = ends.join(inside, "pattern", "left").select("pattern", F.coalesce("inside", F.shiftleft("last", HASH_BITS - RANGE_BITS) - 1).alias("edge"))
    return chosen.join(edges, "pattern", "left").select("pattern", F.col("passes").cast("int").alias("passes"), F.coalesce("edge", F.lit(-1).cast("long")).alias("edge"), "source_size", "target")


def taken_times(h: Column) -> Column:
    return F.col("passes") + F.when(h <= F.col("edge"), 1).otherwise(0)


def mix(docs: DataFrame, members: Column, doc_id: str, size: Column, weights: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with ``times``, the plan of each pattern): how often each row of ``docs`` is taken for the mix.

    ``members`` is an array of the sources of a row; a null or empty array belongs to no source and is not taken.  The columns of ``docs`` stay, after them come ``times``
    and ``__``-named helpers.  Rows of one id share a hash, so repeated rows are taken alike; null ids count as one id.  An empty table gives an empty table.
    """
    told = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    name = lambda c: "`" + c.replace("`", "``") + "`"
    row = F.struct(*[F.col(name(c)).alias(c) for c in docs.columns])
    own = docs.select(row.alias("__row"), told.alias("__members"), size.cast("long").alias("__size"), seeded(F.col(name(doc_id)), seed).alias("__h"))
    own = own.withColumn("__pattern", F.to_json("__members"))
    slim = own.select(F.col("__pattern").alias("pattern"), F.col("__members").alias("members"), F.col("__size").alias("size"), F.col("__h").alias("h")).where(F.size("members") > 0)
    plan = cut(takes(cut(slim), weights, seed))
    out = own.join(small(plan), F.col("__pattern") == F.col("pattern"), "left")
    return out.select("__row", "__size", "source_size", "target", F.coalesce(taken_times(F.col("__h")), F.lit(0)).alias("times")), plan
