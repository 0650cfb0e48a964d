"""Searching a stated set of query vectors against all vectors, shard by shard.

Space is cut into cells by splits of a bounded sample; every row is dealt to its cell, and a cell with more rows than a shard holds to several shards.  A shard's rows
and the queries that visit it are sorted into one partition, rows first: the task builds the shard's index once, keeps its tight bounding box, and streams the queries
past it.  A query first visits the shard of its own row; the k-th score found there sends it on only to shards whose box can hold as high a score.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import cut

#: Rows of a shard; shards at most (with more rows, shards are larger), as the boxes of all are broadcast: a kilobyte each for 64 components.
SHARD_ROWS, SHARDS = 8192, 1 << 16
#: Rows that the cells are split by, about: those with the smallest hashes.  Cells are split while they have as many of them as LEAST.
SAMPLE, LEAST = 20_000, 64
#: Queries that are searched at once.
BLOCK = 256


def usable(vectors: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """vec_id long, v array<double>: rows whose vector is not null and has finite components only.

    ``zero``: whether a vector of zeros takes part, as an empty one is.
    """
    v = F.col("v")
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fit = fit & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(fit & F.col("vec_id").isNotNull())


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which leave inner products as they are."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; every tie at the edge is considered."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Cells:
    """Splits of a sample, the largest part first, at the mean of its widest side: (side, value) by the path from the top, a leading 1 and then a bit for each split."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: dict[int, tuple[int, float]] = {}
        parts = [(-len(points), 1, points)]
        while parts and len(self.splits) + 1 < cells:
            _, path, own = heapq.heappop(parts)
            if len(own) < LEAST:
                break
            side = int(np.argmax(np.ptp(own, axis=0)))
            value = float(np.mean(own[:, side]))
            low = own[:, side] < value
            if low.any() and not low.all():
                self.splits[path] = side, value
                for p, part in ((2 * path, own[low]), (2 * path + 1, own[~low])):
                    heapq.heappush(parts, (-len(part), p, part))

    def of(self, points: np.ndarray) -> np.ndarray:
        path, todo = np.ones(len(points), dtype=np.int64), [(1, np.arange(len(points)))]
        while todo:
            p, at = todo.pop()
            path[at] = p
            if p in self.splits and len(at):
                side, value = self.splits[p]
                high = points[at, side] >= value
                todo += [(2 * p, at[~high]), (2 * p + 1, at[high])]
        return path


def _sharded(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, int]:
    """``rows`` with ``shard``, and the number of shards."""
    each = max(SHARD_ROWS, -(-n // SHARDS))
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("v").toPandas()["v"] if n > each else []
    cells = Cells(matrix(pa.array(drawn, pa.list_(pa.float64())), width), -(-n // each))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(matrix(batch.column(2), width)))], ["row", "vec_id", "v", "cell"])

    dealt = rows.mapInArrow(run, "row long, vec_id long, v array<double>, cell long")
    sizes = dealt.groupBy("cell").count().collect()
    first, parts = 0, []
    for cell, size in sorted((r[0], r[1]) for r in sizes):
        parts.append((cell, first, -(-size // each)))
        first += parts[-1][2]
    if not parts:
        return dealt.select("row", "vec_id", "v", F.lit(0).alias("shard")), 0
    told = F.broadcast(rows.sparkSession.createDataFrame(parts, "cell long, first int, parts int"))
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return dealt.join(told, "cell").select("row", "vec_id", "v", shard.alias("shard")), first


RESULT = "shard int, query_row long, query_id long, vec_id long, score double, low array<double>, high array<double>"
_RESULT = pa.schema([("shard", pa.int32()), ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _visited(rows: DataFrame, visits: DataFrame, shards: int, width: int, index: Callable, k: int) -> DataFrame:
    """RESULT: what the ``visits`` (shard, row, vec_id, v, kth) find in their shards, and a row with each shard's box."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, built = None, [], None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(edge, edge[1:]):
                part = batch.slice(a, b - a)
                if of[a] != shard:
                    shard, held, built = of[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if built is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    held, points = [], matrix(table["v"].combine_chunks(), width)
                    built = index(points, table["vec_id"].to_numpy(), table["row"].to_numpy()) if len(points) else False
                    if built:
                        box = [[int(shard)], [None], [None], [None], [None], [points.min(axis=0)], [points.max(axis=0)]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(box, _RESULT)], schema=_RESULT)
                for i in range(0, part.num_rows if built else 0, BLOCK):
                    asked = part.slice(i, BLOCK)
                    row, vec_id, kth = asked["row"].to_numpy(), asked["vec_id"].to_numpy(), asked["kth"].to_numpy(zero_copy_only=False)
                    found = list(built.search(matrix(asked["v"], width), row, np.where(np.isnan(kth), -np.inf, kth), k))
                    each = [len(ids) for ids, _ in found]
                    n = sum(each)
                    values = [pa.array(np.full(n, shard), pa.int32()), pa.array(np.repeat(row, each)), pa.array(np.repeat(vec_id, each)), *(pa.array(np.concatenate(x)) for x in zip(*found)), *[pa.nulls(n, pa.list_(pa.float64()))] * 2]
                    yield pa.RecordBatch.from_arrays(values, schema=_RESULT)

    none = F.lit(None).cast("double")
    both = rows.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "v", none.alias("kth")).unionByName(visits.select("shard", F.lit(1).alias("kind"), "row", "vec_id", "v", "kth"))
    return both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, RESULT)


def search(vectors: DataFrame, vec_id: str, vector: str, every: int, k: int, index: Callable, score_type: str, zero: bool, to: Callable | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products that ``index`` finds for each row whose id is divisible by ``every``.

    ``index(points, ids, rows)`` is built once a shard and visit of it; its ``search(queries, own rows, kth, k)`` yields ids and scores of each query, at least its kth.
    ``to`` changes components before anything else.
    """
    whole = usable(vectors, vec_id, vector, zero)
    if to is not None:
        whole = whole.withColumn("v", F.transform("v", to))
    rows = cut(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    dealt, shards = _sharded(rows, n, width)
    dealt = cut(dealt)
    asked = dealt.where(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("double")
    first = cut(_visited(dealt, asked.withColumn("kth", none), shards, width, index, k))
    found = first.where("query_row IS NOT NULL")
    if shards > 1:
        kth = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        boxes = first.where("query_row IS NULL").select("shard", "low", "high").toPandas().sort_values("shard")
        named, low, high = boxes["shard"].to_numpy(), np.stack(boxes["low"].to_list()), np.stack(boxes["high"].to_list())
        # Shards that no query's own row is in have no box yet, and are visited by all.
        blind = np.setdiff1d(np.arange(shards), named)
        shared = rows.sparkSession.sparkContext.broadcast((named, low, high, blind))

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            named, low, high, blind = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(i, BLOCK)
                    q, kth = matrix(part["v"], width), part["kth"].to_numpy(zero_copy_only=False)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    bound += 1e-9 * np.abs(bound)
                    own = part["shard"].to_numpy()
                    visit = (np.isnan(kth)[:, None] | (bound >= kth[:, None])) & (named[None, :] != own[:, None])
                    to = [np.concatenate([named[v], blind]).astype(np.int32) for v in visit]
                    yield pa.RecordBatch.from_arrays([part["row"], part["vec_id"], part["v"], part["kth"], pa.array(to, pa.list_(pa.int32()))], ["row", "vec_id", "v", "kth", "shards"])

        told = asked.join(kth, asked["row"] == kth["query_row"], "left").select("row", "vec_id", "v", "kth", "shard")
        routed = told.mapInArrow(route, "row long, vec_id long, v array<double>, kth double, shards array<int>")
        visits = routed.select(F.explode("shards").alias("shard"), "row", "vec_id", "v", "kth")
        found = found.unionByName(_visited(dealt, visits, shards, width, index, k).where("query_row IS NOT NULL"))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast(score_type).alias("score"))
