"""Approximate nearest neighbours by a forest of sorted hash strings.

A shard keeps TREES sorted arrays of BITS-bit hash strings of its rows' directions, each bit the side of a random hyperplane.  A query descends in every tree to its
longest matching prefix, found by binary search, and then all trees ascend together, one bit at a time.  At each step a row below a tree's prefix gains a point, so that
a row's points are the lengths of the prefixes that it shares with the query, over all trees.  Points tell angles; times its norm, what a row has above the median
tells its inner product.  The rows with the most of this are scored on the original vectors in double precision.

Where the ascent stops, and how many rows are looked at, is measured when a shard is built: for some of its own rows the true neighbours are found, and the ascent stops
at the deepest level at which the first tenth of the shard's rows holds TARGET of them.  If none does, as in small shards of vectors without any order, it goes to the
top and looks at as many rows as that takes.  The hyperplanes come from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from quire.llm import vectors as V

TREES, BITS, SEED = 128, 32, 20_240
#: Share of held-out rows' neighbours that is to be found, how many rows are held out, and the share of a shard that is looked at if this suffices.
TARGET, HELD_OUT, SHARE = 0.94, 48, 0.1

#: A range of more rows is taken as a slice, not row by row.
LONG = 100


def hashes(points: np.ndarray) -> np.ndarray:
    """TREES x rows hash strings, the first bit the highest."""
    planes = np.random.default_rng(SEED).standard_normal((points.shape[1], TREES * BITS)).astype(np.float32)
    weight, out = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.float64), []
    for a in range(0, len(points), 1024):
        part = points[a : a + 1024]
        # Directions: norms beyond the range of the smaller floats do no harm.
        scale = np.abs(part).max(axis=1, keepdims=True, initial=0)
        sides = ((part / np.where(scale > 0, scale, 1)).astype(np.float32) @ planes > 0).reshape(-1, TREES, BITS)
        out.append((sides @ weight).astype(np.int64))
    return np.concatenate(out).T


class Forest:
    def __init__(self, points: np.ndarray, ids: np.ndarray | None = None, rows: np.ndarray | None = None, k: int = 20):
        self.points, self.ids, self.rows = points, ids, rows
        n = len(points)
        self.norm = np.sqrt((points**2).sum(axis=1))
        codes = hashes(points)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, axis=1)
        # Deeper than this no two strings of a shard agree but by being near.
        self.deepest = min(BITS, int(n).bit_length() + 4)
        # Where the strings with each prefix of ``tabled`` bits begin: shorter prefixes are found there without a search.
        self.tabled = min(self.deepest, int(n).bit_length())
        self.begin = np.zeros((TREES, (1 << self.tabled) + 1), dtype=np.int32)
        for own, prefix in zip(self.begin, self.codes >> (BITS - self.tabled)):
            np.cumsum(np.bincount(prefix, minlength=1 << self.tabled), out=own[1:])
        self.stop, self.look = self._measured(codes, k)

    def _measured(self, codes: np.ndarray, k: int) -> tuple[int, int]:
        """The level at which the ascent stops, and how many rows are looked at then."""
        n = len(self.points)
        if n <= k + 1:
            return 1, n
        own = np.unique(np.linspace(0, n - 1, min(n, HELD_OUT)).astype(np.int64))
        score = self.points[own] @ self.points.T
        score[np.arange(len(own)), own] = -np.inf
        true = np.argpartition(-score, k - 1, axis=1)[:, :k]
        points = np.zeros((len(own), n), dtype=np.int32)
        best = (1, n)
        for level in range(self.deepest, 0, -1):
            first, size = self.ranges(codes[:, own], level)
            for i in range(len(own)):
                points[i] += self._points(first[:, i] + np.arange(TREES) * n, size[:, i])
            ranks = []
            for p, at, mine in zip(points, true, own):
                worth = self._worth(p)
                worth[mine] = -np.inf
                # Ties count against a neighbour.
                ranks.append(n - np.searchsorted(np.sort(worth), worth[at], side="left"))
            # The query's own row takes a place too.
            look = min(n, max(k, int(np.sort(np.concatenate(ranks))[int(np.ceil(TARGET * len(own) * k)) - 1])) + 1)
            if look <= SHARE * n:
                return level, look
            best = level, look
        return best

    def _worth(self, points: np.ndarray) -> np.ndarray:
        return (points - np.median(points)) * self.norm

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree (row) and query (column), where the strings that share the first ``length`` bits begin, and how many they are."""
        if length <= self.tabled:
            prefix, trees = codes >> (BITS - length), np.arange(TREES)[:, None]
            a, b = (self.begin[trees, x << (self.tabled - length)].astype(np.int64) for x in (prefix, prefix + 1))
            return a, b - a
        low = codes >> (BITS - length) << (BITS - length)
        high = low + (1 << (BITS - length))
        a = np.stack([np.searchsorted(own, x) for own, x in zip(self.codes, low)])
        return a, np.stack([np.searchsorted(own, x) for own, x in zip(self.codes, high)]) - a

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, the rows that are worth most when the ascent stops, ties at the edge included."""
        n, look = len(self.points), self.look
        codes = hashes(queries)
        levels = [self.ranges(codes, x) for x in range(self.stop, self.deepest + 1)]
        first = np.concatenate([a for a, _ in levels]) + np.tile(np.arange(TREES) * n, len(levels))[:, None]
        size = np.concatenate([b for _, b in levels])
        for q in range(len(queries)):
            points, level = self._points(first[:, q], size[:, q]), self.stop
            while level > 1 and np.count_nonzero(points) < look:
                level -= 1
                a, b = self.ranges(codes[:, q : q + 1], level)
                points += self._points(a[:, 0] + np.arange(TREES) * n, b[:, 0])
            worth = self._worth(points)
            yield np.flatnonzero(worth >= np.partition(worth, n - look)[n - look])

    def _points(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each row, in how many of the ranges (``first`` and ``size``) of all trees' orders it is."""
        order, long = self.order.ravel(), size > LONG
        parts = [order[a:b] for a, b in zip(first[long].tolist(), (first + size)[long].tolist())]
        short = (size > 0) & ~long
        first, size = first[short], size[short]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(np.concatenate([order[at], *parts]), minlength=len(self.points))

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, q, row, edge in zip(self.candidates(queries), queries, own, kth):
            at = at[self.rows[at] != row]
            score = self.points[at] @ q
            at, score = at[score >= edge], score[score >= edge]
            best = V.top(score, self.ids[at], k)
            yield self.ids[at][best], score[best]


def nearest(vectors: DataFrame, vec_id: str, vector: str, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product for each query row (vec_id divisible by ``every``).

    Every usable row is indexed.  Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an
    id take no part; shorter vectors count as filled with zeros.  A repeated query row is answered once for each time it is there.
    Candidates are all rows but the query's own, also others with its id; ties go to the smaller id; an empty table gives no rows.
    """
    return V.search(vectors, vec_id, vector, every, k, lambda points, ids, rows: Forest(points, ids, rows, k), "double", zero=False)
