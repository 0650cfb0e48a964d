"""Exact top-k search by inner product: a KD-tree per shard, best-first with box-to-query bounds.

Each shard's tree splits at the median of the widest side and keeps tight bounding boxes.  No point in a box has a
higher inner product with q than ``max(q, 0) . high + min(q, 0) . low``; nodes are visited by that bound, and a node
whose bound is below the k-th score so far is not opened.  The k-th score is propagated: every query first
searches the shard that its own row falls in, and takes the k-th score it found there to the others, of which it
visits those whose box can hold as high a score (``vectors``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import vectors as V

#: Points of a leaf.
LEAF = 128


class KdTree:
    """Nodes in arrays: boxes, children (or -1) and the range of points; ``ids`` and ``rows`` tell the points apart."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.order = np.arange(len(points))
        low, high, child, span = [], [], [], []

        def grow(a: int, b: int) -> int:
            own = points[self.order[a:b]]
            node = len(low)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            span.append((a, b))
            child.append((-1, -1))
            wide = int(np.argmax(high[node] - low[node]))
            if b - a > LEAF and high[node][wide] > low[node][wide]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], mid)]
                child[node] = (grow(a, a + mid), grow(a + mid, b))
            return node

        grow(0, len(points))
        self.low, self.high, self.child, self.span = np.array(low), np.array(high), child, span
        self.points, self.ids, self.rows = points[self.order], ids[self.order], rows[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best that are at least ``kth``, but for the row ``own``; ties go to smaller ids."""
        best_s, best_i, heap = np.empty(0), np.empty(0, dtype=np.int64), [(-bound[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            if -upper < kth:
                break
            if (pair := self.child[node])[0] >= 0:
                for x in pair:
                    if bound[x] >= kth:
                        heapq.heappush(heap, (-bound[x], x))
                continue
            a, b = self.span[node]
            s = self.points[a:b] @ q
            near = np.flatnonzero((s >= kth) & (self.rows[a:b] != own))
            if len(near):
                s, i = np.concatenate([best_s, s[near]]), np.concatenate([best_i, self.ids[a:b][near]])
                at = V.top(s, i, k)
                best_s, best_i = s[at], i[at]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
        return best_i, best_s

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for q, bound, row, edge in zip(queries, self.bounds(queries), own, kth):
            yield self.best(q, bound, row, k, edge)


def top_k(vectors: DataFrame, vec_id: str, vector: str, every: int, k: int, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for each query row (vec_id divisible by ``every``).

    Components x count as ``floor(scale * x)``.  Vectors that are null or hold null or non-finite components, and rows without an id take no
    part; shorter vectors, also empty ones, count as filled with zeros.  A repeated query row is answered once for each time it is there.  Candidates are all rows but the query's own,
    also others with its id; ties go to the smaller id; an empty table gives no rows.  Products are exact while they stay below 2**53.
    """
    return V.search(vectors, vec_id, vector, every, k, KdTree, "long", zero=True, to=lambda x: F.floor(x * scale).cast("double"))
