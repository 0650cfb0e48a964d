"""Many terms against many texts, without looking at each text once for each term.

Of every term a hash and an anchor are kept: the hash of its first 1, 2, 4 or 8 characters, as many as it has.  Rolling hashes of a text are formed for these four lengths
at once; where one is an anchor, the whole hashes of the lengths that terms with this anchor have are looked up.  What is found is given as the pieces of the text
themselves, each once, and joins the terms by equality, so that no hit costs another look at its text.  The index is arrays of numbers of at most TERMS_AT_ONCE terms (and
as many translations, if they are looked for); texts are passed once for each such part of the terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different terms of one index (24 bytes each, and a filter of a byte for each of 2**FILTER_BITS slots).
TERMS_AT_ONCE, FILTER_BITS = 500_000, 22
#: Terms that are broadcast to meet what was found; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
ANCHORS = (1, 2, 4, 8)
#: Characters of texts that are hashed at once, about.
SPAN = 1 << 19

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWER = [np.uint64(pow(_BASE, n, 1 << 64)) for n in range(9)]
_END = b"\xff\xff\xff\xff"


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts, each text followed by one that no text has, and where the texts begin."""
    data = [t.encode("utf-32-le") for t in texts]
    return np.frombuffer(_END.join([*data, b""]), np.uint32), np.concatenate([[0], np.cumsum([len(d) // 4 + 1 for d in data])]).astype(np.int64)


def _rolling(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each anchor length, the hash of the characters from each place on; near the end it takes in what is there."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) + np.uint64(1)
        out = {1: h}
        for n in (1, 2, 4):
            h = h + _POWER[n] * np.append(h[n:], np.zeros(min(n, len(h)), np.uint64))
            out[2 * n] = h
    return out


def _anchor(n: np.ndarray) -> np.ndarray:
    return np.select([n >= 8, n >= 4, n >= 2], [8, 4, 2], 1)


class _Sums:
    """Hashes of any stretch of characters by prefix sums of powers."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(codes) + 1
            ones = lambda b: np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
            self.inverse = ones(np.uint64(pow(_BASE, -1, 1 << 64)))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * ones(np.uint64(_BASE & _MASK))[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _spread((self.sums[start + n] - self.sums[start]) * self.inverse[start] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and anchor hash of each term; an empty one has length 0."""
    codes, begin = _codes(terms)
    n = np.diff(begin) - 1
    rolling, anchor = _rolling(codes), np.zeros(len(terms), np.uint64)
    for q in ANCHORS:
        own = (_anchor(n) == q) & (n > 0)
        anchor[own] = _spread(rolling[q][begin[:-1][own]])
    return _Sums(codes).of(begin[:-1], n), n, anchor


class Index:
    """Terms by anchor, and their whole hashes."""

    def __init__(self, full: np.ndarray, n: np.ndarray, anchor: np.ndarray):
        self.empty = [""] if (n == 0).any() else []
        full, n, anchor = full[n > 0], n[n > 0], anchor[n > 0]
        self.full = np.unique(full)
        self.parts = []
        for q in ANCHORS:
            own = _anchor(n) == q
            pairs = np.unique(np.stack([anchor[own], n[own].astype(np.uint64)], axis=1), axis=0) if own.any() else np.empty((0, 2), np.uint64)
            keys, at = np.unique(pairs[:, 0], return_index=True)
            slots = np.zeros(1 << FILTER_BITS, bool)
            slots[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.parts.append((q, keys, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64), slots))

    def find(self, texts: list[str]) -> list[list[str]]:
        """The different pieces of each text that have a term's hash, that is the terms in it."""
        codes, begin = _codes(texts)
        rolling, sums = _rolling(codes), _Sums(codes)
        where, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, keys, at, lengths, slots in self.parts:
            if not len(keys):
                continue
            h = _spread(rolling[q])
            maybe = np.flatnonzero(slots[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            maybe, k = maybe[keys[k] == h[maybe]], k[keys[k] == h[maybe]]
            each = at[k + 1] - at[k]
            place = np.repeat(maybe, each)
            n = lengths[np.repeat(at[k] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())] if len(k) else place
            fits = place + n <= len(codes)
            place, n = place[fits], n[fits]
            whole = sums.of(place, n)
            j = np.minimum(np.searchsorted(self.full, whole), len(self.full) - 1)
            same = self.full[j] == whole
            where.append(place[same]), size.append(n[same])
        where, size = np.concatenate(where), np.concatenate(size)
        of = np.searchsorted(begin, where, side="right") - 1
        order = np.argsort(of, kind="stable")
        start = (where - begin[of])[order]
        cuts, start, stop = np.searchsorted(of[order], np.arange(len(texts) + 1)).tolist(), start.tolist(), (start + size[order]).tolist()
        return [[*self.empty, *{text[i:j] for i, j in zip(start[a:b], stop[a:b])}] for text, a, b in zip(texts, cuts, cuts[1:])]


def _spans(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts that are not null, in lists of about SPAN characters."""
    at, own, size = [], [], 0
    for i, text in enumerate(texts):
        if text is not None:
            at.append(i), own.append(text)
            size += len(text)
            if size >= SPAN:
                yield at, own
                at, own, size = [], [], 0
    if own:
        yield at, own


def _hash_terms(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        full, n, anchor = hashed(batch["word"].tolist())
        yield pd.DataFrame({"full": full.view(np.int64), "n": n, "anchor": anchor.view(np.int64)})


def _finder(words: DataFrame):
    """A function from texts to arrays of those of the ``words`` (a column of that name without nulls, TERMS_AT_ONCE or twice as many rows at most) that are in them."""
    own = words.mapInPandas(_hash_terms, "full long, n long, anchor long").distinct().toPandas()
    told = words.sparkSession.sparkContext.broadcast(Index(own["full"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64), own["anchor"].to_numpy(np.int64).view(np.uint64)))

    def run(texts: pd.Series) -> pd.Series:
        out = [None] * len(texts)
        for at, own in _spans(texts.tolist()):
            for i, found in zip(at, told.value.find(own)):
                out[i] = found
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")


def found_terms(rows: DataFrame, text: str, terms: DataFrame, term: str, target: str | None = None, translation: str | None = None) -> DataFrame:
    """rows joined with those of ``terms`` whose term is in ``text``, both in lower case; an empty term is in every text, a null one in none.

    Columns are those of rows and of terms, whose names must differ.  With ``target``, also ``kept``: whether the term's ``translation`` is in that column, in lower case too;
    null if one of them is.
    """
    low = terms.where(F.col(term).isNotNull()).withColumn("__term", F.lower(F.col(term)))
    low = low.withColumn("__translation", F.lower(F.col(translation))) if target else low
    several = lambda c: low.select(F.col(c).alias("word")).where("word IS NOT NULL").distinct()
    parts, out = max(1, -(-several("__term").count() // TERMS_AT_ONCE)), None
    few = terms.count() <= BROADCAST_TERMS
    whole = low
    for part in range(parts):
        low = whole.where(F.pmod(F.xxhash64("__term"), F.lit(parts)) == part)
        # The same column is looked through once, for both.
        words = several("__term").union(several("__translation")).distinct() if target == text else several("__term")
        found = rows.withColumn("__found", _finder(words)(F.lower(F.col(text))))
        if target:
            found = found.withColumn("__there", F.col("__found") if target == text else _finder(several("__translation"))(F.lower(F.col(target))))
        found = found.withColumn("__term", F.explode("__found"))
        hits = found.join(F.broadcast(low) if few else low, "__term")
        hits = hits.select(*rows.columns, *terms.columns, *([F.array_contains("__there", F.col("__translation")).alias("kept")] if target else []))
        out = hits if out is None else out.unionByName(hits)
    return out
