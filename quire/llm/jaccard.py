"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds.

Documents with equal sets of n-grams are one class, so the product is over classes.  Two linked sets of at most ``r`` n-grams differ in at most ``d`` of them, a bound that
follows from their sizes.  The columns of the incidence, the n-grams, are dealt by hash range to ``m = d + 1 + e`` parts, so linked rows are equal in at least ``e + 1``
whole parts.  Rows that are equal in as many parts as they must be are put in one family, and only rows of a family are multiplied: in blocks of bounded size, a range of columns at a time,
adding up overlaps and discarding pairs that cannot reach the threshold any more.  A block sends a spanning forest of its links, never all pairs.

A part shared by many rows without their being similar (a common passage) makes no family: of the parts that a row shares with others, as many of the most frequent
are left out as a linked row must share beyond one.  Families too large for one block are compared with a few of their most connected members first; then only what is
outside a family's largest component is compared with the rest, block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import cut, discard
from quire.llm.text_hash import Words, mix, shingles, slices

#: Rows of a block and n-grams of all of them together, about; columns of the incidence that are multiplied at once, and members that a large family is compared with first.
BLOCK, GRAMS, COLUMNS, PIVOTS = 512, 1 << 20, 4096, 3
#: Rows that are told by a broadcast of their keys; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows that are left out by a broadcast of their keys.
LEFT_OUT = 4_000_000
#: Bits of a part's token; its lowest bit is that of its band.
TOKEN_BITS = 48


class Bands:
    """Sizes in bands [low, low / t]: linked sets are in one band or in neighbours, so a set takes part in its own band and in the next."""

    def __init__(self, num: int, den: int):
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low[:-1], dtype=np.int64)
        high = np.array(low[1:], dtype=np.int64) - 1
        #: Most n-grams that two linked sets of the band differ in; spare parts, more where the parts are so small that some are empty; parts.
        self.differ = (den - num) * 2 * high // (den + num)
        self.spare = 3 + self.differ * 5 * (den - num) // (3 * den)
        self.parts = self.differ + 1 + self.spare


def tokens(grams: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of ``size`` sorted ``grams`` each: row, token and need of each of their parts.

    A token stands for a part, the n-grams in it and its band.  Linked rows share at least ``need`` tokens of one band, whichever's need is taken: e + 1 parts are
    equal, and those of them that are empty have no token.  A row with more than e empty parts has tokens for these too, and needs one.
    """
    rows, found, needs = [], [], []
    of = np.repeat(np.arange(len(size)), size)
    own = np.searchsorted(bands.low, size, side="right") - 1
    with np.errstate(over="ignore"):
        mixed = mix(grams)
        for next_ in (0, 1):
            band = own + next_
            on = (size > 0) & (bands.differ[band] > 0)
            if not on.any():
                continue
            use = on[of]
            g, x, at = grams[use], mixed[use], of[use]
            part = ((g >> np.uint64(32)) * bands.parts[band].astype(np.uint64)[at]) >> np.uint64(32)
            start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
            row, part, value = at[start], part[start], np.add.reduceat(x, start)
            empty = bands.parts[band] - np.bincount(row, minlength=len(size))
            over = on & (empty > bands.spare[band])
            for r in np.flatnonzero(over):
                idle = np.setdiff1d(np.arange(bands.parts[band[r]], dtype=np.uint64), part[row == r])
                row, part, value = np.concatenate([row, np.full(len(idle), r)]), np.concatenate([part, idle]), np.concatenate([value, np.zeros(len(idle), np.uint64)])
            b = band[row].astype(np.uint64)
            token = mix(value ^ mix(part * np.uint64(4096) + b + np.uint64(1))) >> np.uint64(64 - TOKEN_BITS)
            rows.append(row)
            found.append(token & ~np.uint64(1) | b & np.uint64(1))
            needs.append(np.where(over, 1, bands.spare[band] + 1 - empty)[row])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(found)[order].view(np.int64), np.concatenate(needs)[order]


def _signature(g: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        node, check = np.sum(mix(g), dtype=np.uint64), np.bitwise_xor.reduce(mix(g + np.uint64(len(g)))) if len(g) else np.uint64(0)
    return int(node.view(np.int64)), int(np.uint64(check).view(np.int64))


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key, text; rows with one key are repetitions of one row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, key, n, node (64 bits of the set's signature), check (64 more); one row a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            made = [(len(g), *_signature(g)) for g in shingles(Words(texts), k)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(x, pa.int64()) for x in zip(*made))], ["doc_id", "key", "n", "node", "check"])

    return rows.mapInArrow(run, "doc_id long, key long, n long, node long, check long")


def _posted(rows: DataFrame, k: int, bands: Bands, copied: DataFrame) -> DataFrame:
    """token, node, need: the tokens of one document of each class; ``copied`` (of, rep) names it for classes of several."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets = list(shingles(Words(texts), k))
            size = np.array([len(g) for g in sets], dtype=np.int64)
            row, token, need = tokens(np.concatenate(sets), size, bands)
            each = np.bincount(row, minlength=len(sets))
            node = pa.array([_signature(g)[0] for g in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(1), node, _lists(token, each), _lists(need.astype(np.int32), each)], ["key", "node", "token", "need"])

    made = rows.mapInArrow(run, "key long, node long, token array<bigint>, need array<int>")
    one = made.join(copied, made["node"] == copied["of"], "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("key")))
    return one.select("node", F.explode(F.arrays_zip("token", "need")).alias("x")).select("x.token", "node", "x.need")


def _edges(posts: DataFrame) -> DataFrame:
    """a, b, w: chains of nodes that share enough tokens, by way of the first node of each token; w counts whom ``a`` meets there.

    Of the tokens of a band that a node shares with others, the need - 1 most frequent are left out: linked nodes share one of the others still.
    """
    same, mine = Window.partitionBy("token"), Window.partitionBy("node", F.col("token").bitwiseAND(F.lit(1)))
    shared = posts.select("token", "node", "need", F.count("*").over(same).alias("c"), F.min("node").over(same).alias("first")).where("c > 1")
    ranked = shared.withColumn("rank", F.dense_rank().over(mine.orderBy("c", "token"))).withColumn("all", F.max("rank").over(mine))
    kept = ranked.where(F.col("rank") <= F.col("all") - F.col("need") + 1)
    return kept.groupBy(F.col("node").alias("a"), F.col("first").alias("b")).agg(F.sum("c").alias("w"))


def linked_in_block(grams: np.ndarray, size: np.ndarray, left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of rows of ``size`` grams each, of which one at least is in ``left``.

    Overlaps add up over ranges of columns; a row leaves when none of its pairs can reach the least overlap for their sizes any more.
    """
    of = np.repeat(np.arange(len(size)), size)
    _, column, often = np.unique(grams, return_inverse=True, return_counts=True)
    use = often[column] > 1
    column, of = (np.cumsum(often > 1) - 1)[column[use]], of[use]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    rows = np.arange(len(size))
    a, b, rest = np.flatnonzero(left), rows, np.bincount(of, minlength=len(size)).astype(np.float32)
    need = -(-(size[a][:, None] + size[None, :]) * num // (num + den))
    overlap = np.zeros((len(a), len(b)), dtype=np.float32)
    end = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, end, COLUMNS):
        possible = overlap + np.minimum(rest[a][:, None], rest[b][None, :]) >= need
        in_a, in_b = possible.any(axis=1), possible.any(axis=0)
        if not in_a.any():
            break
        a, b, need, overlap = a[in_a], b[in_b], need[in_a][:, in_b], overlap[in_a][:, in_b]
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((len(size), min(COLUMNS, end - c)), dtype=np.float32)
        part[of[i:j], column[i:j] - c] = 1
        overlap += part[a] @ part[b].T
        rest -= np.bincount(of[i:j], minlength=len(size))
    parent = list(range(len(size)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    forest = []
    for i, j in zip(*np.nonzero(overlap >= need)):
        ra, rb = root(int(a[i])), root(int(b[j]))
        if ra != rb:
            parent[ra] = rb
            forest.append((int(a[i]), int(b[j])))
    return forest


def _products(rows: DataFrame, cells: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) in the blocks of ``cells`` (node, rep, family, i, j, left).  Each set is formed once, from its document's text, and sent to its blocks."""
    wanted = cut(cells.groupBy("node", "rep").agg(F.collect_list(F.struct("family", "i", "j", "left")).alias("cells")))
    few = wanted.count() <= BROADCAST_IDS
    found = rows.join(F.broadcast(wanted) if few else wanted, rows["key"] == wanted["rep"]).select("node", "cells", "text")

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            made = list(shingles(Words(texts), k))
            same = np.flatnonzero([_signature(g)[0] == node for g, node in zip(made, part.column(0).to_pylist())])
            grams = _lists(np.concatenate([made[i].view(np.int64) for i in same] or [np.empty(0, np.int64)]), np.array([len(made[i]) for i in same], dtype=np.int64))
            own = part.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), grams], ["node", "cells", "grams"])

    def multiply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, first, again = np.unique(table["node"].to_numpy(), return_index=True, return_inverse=True)
        left = np.bincount(again, weights=table["left"].to_numpy()) > 0
        sets = table["grams"].combine_chunks().take(pa.array(first))
        grams, size = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
        pairs = linked_in_block(grams, size.astype(np.int64), left, num, den) if len(node) > 1 else []
        return pa.table({"a": pa.array([node[a] for a, _ in pairs], pa.int64()), "b": pa.array([node[b] for _, b in pairs], pa.int64())})

    sets = found.mapInArrow(form, "node long, cells array<struct<family: bigint, i: bigint, j: bigint, left: boolean>>, grams array<bigint>")
    sets = sets.select("node", "grams", F.explode("cells").alias("x")).select("x.family", "x.i", "x.j", "x.left", "node", "grams")
    out = cut(sets.groupBy("family", "i", "j").applyInArrow(multiply, "a long, b long"))
    discard(wanted)
    return out


def _dealt(salt: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks)


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _links(rows: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of nodes (node, rep, n) within the families that ``edges`` span: enough of them for the components."""
    popular = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    members = components(edges.select("a", "b")).withColumnRenamed("label", "family").join(popular, "node", "left").join(nodes, "node")
    members = cut(members.select("node", "rep", "n", "family", F.coalesce("w", F.lit(0)).alias("w")))
    blocks = F.ceil(F.greatest(F.col("all") / BLOCK, F.col("grams") / GRAMS))
    sizes = members.groupBy("family").agg(F.count("*").alias("all"), F.sum("n").alias("grams")).select("family", "all", blocks.alias("blocks"))
    zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)
    large = cut(members.join(sizes.where("blocks > 1"), "family"))
    small = members.join(large.select("family").distinct(), "family", "left_anti").select("node", "rep", "family", zero.alias("i"), zero.alias("j"), yes.alias("left"))
    best = [F.max_by(F.struct("node", "rep"), F.struct(F.when(_dealt(i, F.lit(PIVOTS)) == 0, F.col("w")).otherwise(-1), "node")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = large.groupBy("family").agg(F.max("blocks").alias("blocks"), *best).select("family", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"), "blocks")
    pivots = pivots.select("p.node", "p.rep", "family", _upto(F.col("blocks")).alias("i"), zero.alias("j"), yes.alias("left"))
    chunks = large.select("node", "rep", "family", _dealt(7, F.col("blocks")).alias("i"), zero.alias("j"), no.alias("left"))
    found = _products(rows, small.unionByName(pivots).unionByName(chunks), k, num, den)
    if large.isEmpty():
        return found
    told = large.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    most = told.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.max("k").alias("largest"))
    told = cut(told.join(most, "family").where("all > largest").withColumn("rests", F.ceil((F.col("all") - F.col("largest")) * F.col("blocks") / F.col("all"))))
    rest = told.where("label <> most").select("node", "rep", "family", _dealt(3, F.col("rests")).alias("i"), _upto(F.col("blocks")).alias("j"), yes.alias("left"))
    every = told.select("node", "rep", "family", _upto(F.col("rests")).alias("i"), _dealt(4, F.col("blocks")).alias("j"), no.alias("left"))
    return found if told.isEmpty() else found.unionByName(_products(rows, rest.unionByName(every), k, num, den))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, for each node that has links; by alternating large and small stars."""
    edges, state = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, cut(small.where("u <> v").distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = now


def classes(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document; sets are linked when den * overlap >= num * union.

    A text with fewer than k words is one shingle, its whole sequence; one without words, or null, is empty, linked with nothing and its own component.  The component is
    named by its smallest doc_id (null if it has only null ids).  Repeated rows stay and are linked; columns other than the two named are not read; an
    empty table gives an empty table.  N-grams and sets are compared as 64-bit hashes.
    """
    rows = _keyed(docs, doc_id, text)
    sets = cut(_sets(rows, k))
    same = sets.where("n > 0").groupBy("node", "check", "n").agg(F.min("doc_id").alias("least"), F.min("key").alias("rep"), F.count("*").alias("copies"))
    nodes = cut(same.select("node", "n", "least", "rep", "copies"))
    several = nodes.where("copies > 1")
    copied = several.select(F.col("node").alias("of"), "rep")
    edges = cut(_edges(_posted(rows, k, Bands(num, den), F.broadcast(copied) if several.count() <= BROADCAST_IDS else copied)))
    labels = components(_links(rows, nodes.select("node", "rep", "n"), edges, k, num, den))
    told = nodes.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").select("node", "least", F.coalesce("label", "node").alias("label"))
    named = told.join(told.groupBy("label").agg(F.min("least").alias("component_id")), "label").select(F.col("node").alias("of"), "component_id")
    out = sets.join(cut(named), (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key")


def one_of_each(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component one row stays, of its smallest doc_id; repeated rows count as copies.

    Texts without words, and rows without an id whose component has no id at all, have no copies but their own repetitions.  Rows to be left out are told by a broadcast of
    their 64-bit keys if there are up to LEFT_OUT of them, so that texts are not shuffled; more are joined by shuffle.
    """
    found = cut(classes(docs, doc_id, text, k, num, den)).where("n_shingles > 0")
    own = found.where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    stay = cut(own.groupBy("component_id", "key").agg(F.count("*").alias("times")))
    first = stay.where("component_id IS NOT NULL").groupBy(F.col("component_id").alias("of")).agg(F.min("key").alias("first"))
    later = stay.join(first, (F.col("component_id") == F.col("of")) & (F.col("key") != F.col("first"))).select("key")
    gone = cut(found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("key").unionByName(later).distinct())
    again = cut(stay.where("times > 1").select("key").join(gone, "key", "left_anti"))
    told = lambda keys: F.broadcast(keys) if keys.count() <= LEFT_OUT else keys
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(docs[doc_id].cast("long"), docs[text]).alias("key"))
    rows = own.join(told(gone), "key", "left_anti")
    if not again.isEmpty():
        rows = rows.join(told(again), "key", "left_anti").unionByName(rows.join(told(again), "key", "left_semi").dropDuplicates(["key"]))
    return rows.select([F.col("row")[c].alias(c) for c in docs.columns])
