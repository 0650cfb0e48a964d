"""Vectorised hashing of the words of many texts: numpy over the texts' bytes, no loop over words.

Words are the runs of bytes other than ASCII white space, with A-Z lower-cased.  A word's hash is a polynomial of its bytes modulo 2**64,
taken as a difference of prefix sums, and then mixed.  Two of n different words share one with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes whose prefix sums are formed at once.
SPAN = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base & _MASK, np.uint64)]).cumprod(dtype=np.uint64)


_POWER: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        size = max(n, SPAN + 4096)
        _POWER[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _POWER[0], _POWER[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a batch of texts: ``hash``, ``doc`` (index of the text), ``first`` and ``last`` word index of each text, ``tail`` (last two bytes)."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode().lower() for t in texts]
        raw = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])]).astype(np.int64)
        space = _IS_SPACE[raw]
        word = ~space
        start = np.flatnonzero(word & np.concatenate([[True], space[:-1]])) if len(raw) else np.empty(0, np.int64)
        stop = np.flatnonzero(word[:-1] & space[1:]) + 1 if len(raw) else start
        self.first = np.searchsorted(start, begins[:-1])
        self.last = np.searchsorted(start, begins[1:])
        self.doc = np.repeat(np.arange(len(data)), self.last - self.first)
        self.hash = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(stop, start[i] + SPAN, side="right")))
            a, b = start[i], stop[j - 1]
            power, inverse = _tables(int(b - a) + 1)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], dtype=np.uint64)])
                s, e = start[i:j] - a, stop[i:j] - a
                self.hash[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j
        if len(start):
            before = np.maximum(stop - 2, start)
            self.tail = raw[before].astype(np.int64) * 256 + raw[stop - 1]
        else:
            self.tail = np.empty(0, np.int64)


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    h = words.hash
    with np.errstate(over="ignore"):
        seed = np.uint64(0x2545F4914F6CDD1D)
        full = np.full(max(0, len(h) - k + 1), k, dtype=np.uint64) * seed
        for j in range(k):
            full = mix(full * seed + h[j : j + len(full)])
        for a, b in zip(words.first.tolist(), words.last.tolist()):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                one = np.array([b - a], dtype=np.uint64) * seed
                for j in range(a, b):
                    one = mix(one * seed + h[j : j + 1])
                yield one
            else:
                yield h[:0]


def slices(batches: Iterable[pa.RecordBatch], size: int = 500, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of up to ``size`` rows, and of about ``most`` bytes, with their texts (the last column)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            while part.num_rows > 1 and part.columns[-1].nbytes > most:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part, part.columns[-1].to_pylist()
