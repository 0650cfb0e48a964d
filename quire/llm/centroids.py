"""Centroid clustering of integer vectors by Lloyd's rounds with Hamerly's bounds.

Each vector keeps two numbers from round to round: an upper bound of the distance to its centroid and a lower bound of the distance to the second nearest.  When
centroids move, the bounds are loosened by their drift; a vector whose upper bound stays below its lower bound, or below half the way from its centroid to the next one,
cannot have changed and is not looked at.  All others are compared exactly with their own centroid and then, if that leaves doubt, with all of them, in integers.
Bounds are floats that are always rounded to the safe side, and equal bounds are doubt, so ties are decided by the exact scan.

Rows are written again after each round with their bounds; sums change only by the vectors that moved.  The driver holds nothing but the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard

#: Components are integers below this in magnitude; 64 squared differences of them fit in 63 bits.  Larger ones are computed as Python integers.
WIDE = 1 << 27
#: Relative slack of every bound, well above the rounding of the few operations that lead to it.
SLACK = 1e-9
#: Vectors that are compared with all centroids at once.
BLOCK = 2048
_STATE = "vec_id long, v array<long>, was int, cluster int, upper double, lower double"


def integers(vectors: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of each component of the vectors with exactly ``width`` of them, none null or not finite.

    Vectors with a component whose integer does not fit in a long take no part.
    """
    v, most = F.col("v"), float(2**63) / scale
    fit = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < most) & (x >= -most))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & fit)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of ``seed:vec_id``, in this order; equal ids in the order of their vectors, missing ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, or of Python integers if any component is WIDE."""
    out = column.flatten().to_numpy().reshape(-1, width)
    return out.astype(object) if len(out) and (out.max() >= WIDE or out.min() <= -WIDE) else out


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows, or of rows to one centroid."""
    return ((v - c) ** 2).sum(axis=1)


class Centroids:
    """Centroids, half the distance from each to its nearest other, and how far each has moved from ``old``."""

    def __init__(self, rows: list[list[int]], old: list[list[int]] | None = None):
        big = any(abs(x) >= WIDE for row in rows for x in row)
        self.at = np.array(rows, dtype=object if big else np.int64)
        k = len(rows)
        apart = np.full(k, np.inf)
        for i in range(k):
            d = np.sqrt(squared(self.at, self.at[i]).astype(np.float64))
            d[i] = np.inf
            apart[i] = d.min()
        self.half = apart / 2 * (1 - SLACK)
        moved = [sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 for a, b in zip(rows, old)] if old else [0.0] * k
        self.drift = np.array(moved, dtype=np.float64) * (1 + SLACK)
        # The farthest drift among the other centroids.
        order = np.argsort(-self.drift)
        self.others = np.full(k, self.drift[order[0]])
        self.others[order[0]] = self.drift[order[1]] if k > 1 else 0.0

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties to the smaller number) and its squared distance, exactly, and a lower bound of the distance to the second."""
        cluster, best, second = np.empty(len(v), np.int32), np.empty(len(v), self._kind(v)), np.full(len(v), np.inf)
        for i in range(0, len(v), BLOCK):
            d = self._all(v[i : i + BLOCK])
            own = np.argmin(d, axis=1)
            cluster[i : i + BLOCK], best[i : i + BLOCK] = own, d[np.arange(len(d)), own]
            if d.shape[1] > 1:
                rest = d.astype(np.float64)
                rest[np.arange(len(d)), own] = np.inf
                second[i : i + BLOCK] = np.sqrt(rest.min(axis=1)) * (1 - SLACK)
        return cluster, best, second

    def _kind(self, v: np.ndarray) -> type:
        return object if object in (v.dtype, self.at.dtype) else np.int64

    def _all(self, v: np.ndarray) -> np.ndarray:
        if self._kind(v) is object:
            return np.array([squared(v, c) for c in self.at], dtype=object).T
        # Products of integers of up to 53 bits are exact in floats too, and there they are fast.
        x, c = v.astype(np.float64), self.at.astype(np.float64)
        most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
        if v.shape[1] * most * most * 4 < 2**53:
            return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
        return np.stack([squared(v, y) for y in self.at], axis=1)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds after this round's centroids, and how many vectors were scanned; a cluster of -1 has no bounds yet."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        known = np.flatnonzero(cluster >= 0)
        own = cluster[known]
        upper[known] = (upper[known] + self.drift[own]) * (1 + SLACK)
        lower[known] = np.maximum((lower[known] - self.others[own]) * (1 - SLACK), 0)
        bound = np.maximum(lower[known], self.half[own])
        doubt = known[upper[known] >= bound]
        # Tighten the upper bound by the true distance before anything is scanned.
        upper[doubt] = np.sqrt(squared(v[doubt], self.at[cluster[doubt]]).astype(np.float64)) * (1 + SLACK)
        open_ = doubt[upper[doubt] >= np.maximum(lower[doubt], self.half[cluster[doubt]])]
        scanned = np.concatenate([np.flatnonzero(cluster < 0), open_])
        cluster[scanned], best, lower[scanned] = self.scan(v[scanned])
        upper[scanned] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        return cluster, upper, lower, len(scanned)


def _round(width: int, told) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = told.value
        for batch in batches:
            old = batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, upper, lower, _ = centroids.assign(matrix(batch.column("v"), width), old, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(old, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "v", "was", "cluster", "upper", "lower"])

    return run


def _moved(width: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task's vectors that changed their cluster: added to the new one and taken from the old."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, width), dtype=object), np.zeros(k, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), width)
            for sign, name in ((1, "cluster"), (-1, "was")):
                to = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(to[to >= 0]).tolist():
                    rows = v[to == c]
                    sums[c] += sign * rows.sum(axis=0).astype(object)
                    n[c] += sign * len(rows)
        for c in np.flatnonzero((n != 0) | (sums != 0).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([int(n[c])], pa.int64()), pa.array([[str(x) for x in sums[c]]], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    return run


def _distances(width: int, told) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = told.value
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            d = squared(matrix(batch.column("v"), width), centroids.at[cluster]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array([x if x < 2**63 else None for x in d], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, start: list[list[int]], rounds: int) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of ``rows`` (vec_id, v array<long>) and the final centroids, after ``rounds`` of assigning and moving, and a last assignment.

    A vector goes to the nearest centroid by squared distance, ties to the smaller number; a centroid moves to the floor of its vectors' mean, exactly, and stays if it
    has none.  A distance beyond a long is null.
    """
    spark, at, old = rows.sparkSession, [list(map(int, c)) for c in start], None
    width, k = len(at[0]), len(at)
    state = cut(rows.select("vec_id", "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")))
    sums, n = [[0] * width for _ in at], [0] * k
    for step in range(rounds + 1):
        told = spark.sparkContext.broadcast(Centroids(at, old))
        before, state = state, cut(state.mapInArrow(_round(width, told), _STATE))
        discard(before)
        if step == rounds:
            break
        moved = state.where("cluster <> was").select("v", "was", "cluster").mapInArrow(_moved(width, k), "cluster int, n long, sums array<string>")
        parts = moved.select("cluster", "n", F.posexplode(F.transform("sums", lambda x: x.cast("decimal(38,0)"))).alias("i", "x"))
        # As many rows as centroids have components, however many tasks there were.
        for c, i, x, m in parts.groupBy("cluster", "i").agg(F.sum("x"), F.sum("n")).collect():
            sums[c][i] += int(x)
            n[c] += int(m) if i == 0 else 0
        at, old = [[s // n[c] for s in sums[c]] if n[c] else at[c] for c in range(k)], at
    out = cut(state.select("vec_id", "v", "cluster").mapInArrow(_distances(width, spark.sparkContext.broadcast(Centroids(at))), "vec_id long, cluster int, distance long"))
    discard(state)
    return out, at


def summary(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia and inertia (distances summed over the cluster and over all, null beyond a long) and centroid_sha256
    (of its components as decimals, joined by commas)."""
    named = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    names = assigned.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string")
    each = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = each.agg(F.try_sum("cluster_inertia").alias("inertia"))
    return assigned.join(F.broadcast(each.join(names, "cluster").crossJoin(total)), "cluster")  # a row for each centroid, and one row


def centroid_clusters(vectors: DataFrame, vec_id: str, vector: str, width: int, scale: int, k: int, seed: int, rounds: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors that ``integers`` keeps; repeated rows are vectors of their own.

    With fewer than k vectors, each is a centroid; without any, there are no rows.
    """
    rows = cut(integers(vectors, vec_id, vector, width, scale))
    start = first_centroids(rows, k, seed)
    if not start:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    return summary(*cluster(rows, start, rounds))
