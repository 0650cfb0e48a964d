"""Token counts by a two-tier lookup on the map side.

A whole text's count is the sum over its white-space-bounded pre-tokens, since no token of the vocabulary spans
white space.  Tier one is a compact broadcast table of the lengths of frequent pre-tokens; what it misses is
encoded by the library once and kept in the worker's cache, if it is short.  No pre-token of the texts is shuffled: the frequent table comes
from summaries, in which a task names only pre-tokens that make up at least ``1 / SHARE`` of what it has read,
so a task sends at most SHARE rows and the table has at most SHARE rows, however large the corpus is.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut

#: The frequent table holds pre-tokens with at least one SHARE-th of all occurrences: at most SHARE of them.
SHARE = 16_384
#: Distinct pre-tokens that a task counts before it drops those that are too rare to be named.
COUNTED = 400_000
#: Entries of each of the two generations of a worker's cache, and the characters of a pre-token that is kept in it at most.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 64

#: Python splits at these, the library's white space does not include them.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class Lengths:
    """Pre-token to length: the broadcast table first, then this worker's cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        #: The table and the younger generation of the cache are one dictionary, so that a look-up is one step.
        self.path, self.frequent, self.young, self.old = path, frequent, dict(frequent), {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Strings that the library takes out of a text before it looks at white space.
        self.apart = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        odd = [any(s in t for s in self.apart) or any(c in t for c in _ODD) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd)]
        if len(self.young) > CACHE_ENTRIES + len(self.frequent):
            self.old, self.young = self.young, dict(self.frequent)
        young, old, get = self.young, self.old, self.young.__getitem__
        if misses := {w for words in split for w in words if w not in young}:
            young.update((w, old[w]) for w in misses if w in old)
            new = [w for w in misses if w not in old]
            short = [w for w in new if len(w) <= CACHE_LENGTH]
            young.update(zip(short, self.whole(short)))
            if len(short) < len(new):
                long = [w for w in new if len(w) > CACHE_LENGTH]
                now = dict(zip(long, self.whole(long)))
                get = lambda w: now[w] if w in now else young[w]
        whole = iter(self.whole([t for t, o in zip(texts, odd) if o]))
        return [next(whole) if o else sum(map(get, words)) for words, o in zip(split, odd)]


_HELD: list[Lengths] = []


def worker_lengths(path: str, frequent: dict[str, int]) -> Lengths:
    """This worker's cache goes on from task to task, as long as the table stays the same."""
    if not _HELD or _HELD[0].frequent != frequent or _HELD[0].path != path:
        _HELD[:] = [Lengths(path, frequent)]
    return _HELD[0]


def frequent_pretokens(docs: DataFrame, text: str) -> list[str]:
    """Pre-tokens with at least one SHARE-th of all occurrences, as far as the tasks' summaries name them.

    The table decides only which tier answers, never a count.
    """

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    words = value.split()
                    total += len(words)
                    counts.update(words)
                    if len(counts) > COUNTED:
                        counts = Counter({w: n for w, n in counts.items() if n * SHARE >= total})
        named = [(w, n) for w, n in counts.items() if n * SHARE >= total]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in named] + [None], pa.string()), pa.array([n for _, n in named] + [total], pa.int64())], ["word", "n"])

    sums = cut(docs.select(F.col(text)).mapInArrow(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = sums.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.word for r in sums.where(F.col("word").isNotNull() & (F.col("n") * SHARE >= total)).select("word").collect()]


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str, limit: int = 2048) -> DataFrame:
    """Return doc_id, n_bytes (UTF-8), n_tokens (as the library counts) and over_limit (n_tokens > limit) per row.

    Null and empty texts have 0 bytes and 0 tokens.  A null doc_id and repeated rows stay as they are; columns
    other than the two named are not read.  Texts with the vocabulary's special strings, or with the separators
    U+001C to U+001F, are counted whole by the library.
    """
    spark = docs.sparkSession
    words = frequent_pretokens(docs, text)
    shared = spark.sparkContext.broadcast(dict(zip(words, Lengths(path, {}).whole(words))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(path, shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = lengths.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
