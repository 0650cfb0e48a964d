"""Language-model scoring with a hashed maximum-entropy model whose softmax is factored by class.

P(word | context) = P(class | context) * P(slot | class, context) * P(word | slot).  The class of a word is a hash of its last two bytes.  A class's most
frequent words have slots of their own; its other words share hashed slots, inside which they follow their counts.  The first two factors are log-linear:
the class has features of the word before (n-gram), of the word before that (skip) and a hash of both (n-gram), the slot has features of its class and the
word before.  Words enter features by buckets: frequent words by buckets of their own, the others by a hash of their ending.  The number of buckets grows with the
training tokens, as their sixth root, so that the contexts told apart grow as their cube root.

Training passes over every training token once for counts of words, and once for counts of (word before, word before that, class) and (word before, class, slot).  These cells are all that the
likelihood's gradient depends on.  They are dealt by the word before, and so are the weights of the features that it takes part in: an update is one Spark job, in which tasks move these weights by
their gradient and write them to the shared folder, and add up what the model expects of the few features that all share, whose gradient step the driver takes.
Scoring is one pass of numpy over batches of texts, which works out the softmax for the contexts that occur; only words too rare to broadcast are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard
from quire.llm.text_hash import Words, mix, slices

#: Classes, and slots of a class (OWN of them for single words).
CLASSES, SLOTS, OWN = 64, 64, 48
#: Words with at least one TIER-th of all training tokens are broadcast: at most TIER words, whatever the corpus.
TIER = 1 << 17
#: Updates, steps of an update on the weights that tasks hold, and the count that is added to a feature's observed and expected counts when its step is scaled.
UPDATES, STEPS, PRIOR = 8, 3, 2.0
#: Tokens that a task counts at once, cells that it holds before it sends them on, and tasks of an update at most.
TOKENS, HELD, TASKS = 1 << 19, 1 << 21, 16
#: Added to every word's count.
ADD = 0.1

END = np.uint64(0xE7D0C0DE5EED0001)
_CLASS = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) % np.uint64(CLASSES)).astype(np.int64)


class Sizes:
    """Buckets that words enter features by, how many of them are single words', and rows of each word before for its pairs with the word before that."""

    def __init__(self, tokens: int):
        self.buckets = 1 << max(5, round(np.log2(max(2, tokens)) / 6 + 3.5))
        self.head, self.pairs = self.buckets * 3 // 4, self.buckets // 2
        #: Cells of one word before: those of the class side, then those of the slot side.
        self.first = self.buckets * CLASSES
        self.cells = self.first + CLASSES * SLOTS
        self.tail = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(99)) % np.uint64(self.buckets - self.head)).astype(np.int64) + self.head

    def pair(self, b1, b2):
        """The row, among those of ``b1``, that a pair of buckets is hashed to."""
        return (mix((b1 * self.buckets + b2).astype(np.uint64) + np.uint64(5)) % np.uint64(self.pairs)).astype(np.int64)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 10; a null id counts as empty text, and so is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10) == 0


class Tokens:
    """Tokens of a batch of texts, each text's words and then its end: hash, class, tail and index of the text."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts)
        n = words.last - words.first
        at = np.arange(len(words.hash)) + words.doc
        self.ends = np.cumsum(n + 1) - 1
        self.hash = np.full(len(words.hash) + len(texts), END)
        self.hash[at] = words.hash
        self.tail = np.zeros(len(self.hash), dtype=np.int64)
        self.tail[at] = words.tail
        self.cls = _CLASS[self.tail]
        self.doc = np.repeat(np.arange(len(texts)), n + 1)
        self.n = n + 1


class Vocabulary:
    """Broadcast part of the counts: the frequent words, who has a slot or bucket of its own, and the sums of shared slots."""

    def __init__(self, words: np.ndarray, cls: np.ndarray, n: np.ndarray, total: int, distinct: int, sums: dict[tuple[int, int], tuple[int, int]]):
        order = np.argsort(words)
        self.words, self.n, cls = words[order], n[order], cls[order]
        self.total, self.distinct, self.sizes = total, distinct, Sizes(total)
        self.base = np.log10(total + ADD * (distinct + 1))
        self.slot, self.bucket = np.full(len(words), -1), np.full(len(words), -1)
        best, used, heads = np.lexsort((self.words, -self.n)), [0] * CLASSES, 1
        best = np.concatenate([best[self.words[best] == END], best[self.words[best] != END]])  # the end has a slot in any case
        shared = np.array([[sums.get((c, s), (0, 0)) for s in range(SLOTS)] for c in range(CLASSES)], dtype=np.float64)
        for i in best:
            c = cls[i]
            if used[c] < OWN:
                self.slot[i] = used[c]
                used[c] += 1
                shared[c, shared_slot(self.words[i])] -= (self.n[i], 1)
            if heads < self.sizes.head:
                self.bucket[i] = heads
                heads += 1
        #: What a word of a shared slot is divided by: all its words' counts, and one more word for all that training did not see.
        self.inside = np.log10(shared[:, :, 0] + ADD * (shared[:, :, 1] + 1))

    def look_up(self, t: Tokens) -> None:
        """Give tokens their place among the frequent words (or -1), slot, and the buckets of the two tokens before (0 before the first)."""
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, t.hash), len(self.words) - 1)
            t.at = np.where(self.words[at] == t.hash, at, -1)
            t.slot = np.where(t.at >= 0, self.slot[at], -1)
            bucket = np.where(t.at >= 0, self.bucket[at], -1)
        else:
            t.at = t.slot = bucket = np.full(len(t.hash), -1)
        t.own = t.slot >= 0
        t.slot = np.where(t.own, t.slot, shared_slot(t.hash))
        bucket = np.where(bucket >= 0, bucket, self.sizes.tail[t.tail])
        starts = t.ends - t.n + 1
        t.b1, t.b2 = np.concatenate([[0], bucket[:-1]]), np.concatenate([[0, 0], bucket[:-2]])[: len(bucket)]
        t.b1[starts] = 0
        t.b2[starts] = 0
        second = starts[t.n > 1] + 1
        t.b2[second] = 0


def shared_slot(word):
    """The slot of a word without one of its own."""
    x = (word >> np.uint64(17)) % np.uint64(SLOTS - OWN)
    return x.astype(np.int64) + OWN


def _count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, cls, n: how often each token is in the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            words, first, n = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
            cls = np.concatenate([c for _, c in held])[first]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(cls), pa.array(n)], ["word", "cls", "n"])

        for _, texts in slices(batches):
            t = Tokens(texts)
            held.append((t.hash, t.cls))
            size += len(t.hash)
            if size >= TOKENS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select(text).mapInArrow(run, "word long, cls long, n long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded summary of the counts that every task gets."""
    slot = F.pmod(F.shiftrightunsigned("word", 17), F.lit(SLOTS - OWN)) + OWN
    sums = counts.groupBy("cls", slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in sums), sum(r.v for r in sums)
    end = int(END.view(np.int64))
    rows = counts.where((F.col("n") * TIER >= total) | (F.col("word") == end)).toPandas()
    return Vocabulary(rows["word"].to_numpy(np.int64).view(np.uint64), rows["cls"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), total, distinct, {(r.cls, r.slot): (r.n, r.v) for r in sums})


def _cells(docs: DataFrame, text: str, vocabulary) -> DataFrame:
    """before, counts (float32): how often each cell of a bucket of the word before occurs in the texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        sizes = vocab.sizes
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def sent() -> pa.RecordBatch:
            before = keys // sizes.cells
            start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            ends = pa.array(np.concatenate([start, [len(keys)]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % sizes.cells, n)]
            return pa.RecordBatch.from_arrays([pa.array(before[start], pa.int32()), *lists], ["before", "cell", "n"])

        for _, texts in slices(batches, 2000):
            t = Tokens(texts)
            vocab.look_up(t)
            at = t.b1 * sizes.cells
            both = np.concatenate([at + t.b2 * CLASSES + t.cls, at + sizes.first + t.cls * SLOTS + t.slot])
            for i in range(0, len(both), TOKENS):
                key, m = np.unique(both[i : i + TOKENS], return_counts=True)
                keys, again = np.unique(np.concatenate([keys, key]), return_inverse=True)
                n = np.bincount(again, weights=np.concatenate([n, m])).astype(np.int64)
                if len(keys) > HELD:
                    yield sent()
                    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(keys):
            yield sent()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = vocabulary.value.sizes.cells, {}
        for batch in batches:
            for b, cell, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sums.setdefault(b, np.zeros(cells))[cell.values.to_numpy()] += n.values.to_numpy()
        for b, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["before", "counts"])

    rows = docs.select(text).mapInArrow(count, "before int, cell array<int>, n array<int>")
    return rows.repartition("before").mapInArrow(add, "before int, counts binary")


class Shared:
    """Weights that all contexts share, or their observed or expected counts: class bias, class by the word before last, slot of a class."""

    def __init__(self, sizes: Sizes, flat: np.ndarray | None = None):
        shapes = {"bias": (CLASSES,), "skip": (sizes.buckets, CLASSES), "slot": (CLASSES, SLOTS)}
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes.values())])
        self.flat = np.zeros(ends[-1]) if flat is None else flat
        self.bias, self.skip, self.slot = (self.flat[a:b].reshape(x) for a, b, x in zip(ends, ends[1:], shapes.values()))


class Own:
    """Weights of the features that a word before takes part in: the class by it, by its pair with the word before that, and the slot of a class by it."""

    def __init__(self, sizes: Sizes, flat: np.ndarray | None = None):
        shapes = {"before": (CLASSES,), "pair": (sizes.pairs, CLASSES), "slot": (CLASSES, SLOTS)}
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes.values())])
        self.flat = np.zeros(ends[-1]) if flat is None else flat
        self.before, self.pair, self.slot = (self.flat[a:b].reshape(x) for a, b, x in zip(ends, ends[1:], shapes.values()))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def class_scores(shared: Shared, before: np.ndarray, pair: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """What the softmax of the classes is taken of; ``before`` and ``pair`` are the rows of the contexts' own weights."""
    return shared.bias + before + shared.skip[b2] + pair


def _moved(observed: np.ndarray, expected: np.ndarray, together: float) -> np.ndarray:
    """A feature's step: its gradient, observed less expected count, over the mean of the two, and over the number of features that act together."""
    return 2 * (observed - expected) / (observed + expected + 2 * PRIOR) / together


def _update(sizes: Sizes, shared: Shared, b1: int, counts: np.ndarray, own: Own, out: Shared, steps: int) -> None:
    """Move ``own`` by ``steps`` gradient steps on the cells of b1, and add to ``out`` what the model then expects (steps < 0: what is observed)."""
    of_class, of_slot = counts[: sizes.first].reshape(-1, CLASSES), counts[sizes.first :].reshape(CLASSES, SLOTS)
    b2 = np.flatnonzero(of_class.any(axis=1))
    seen = of_class[b2]
    if steps < 0:
        out.bias += seen.sum(axis=0)
        out.skip[b2] += seen
        out.slot += of_slot
        return
    row, n, m = sizes.pair(np.int64(b1), b2), seen.sum(axis=1, keepdims=True), of_slot.sum(axis=1, keepdims=True)
    pair = np.zeros_like(own.pair)
    np.add.at(pair, row, seen)
    for step in range(steps + 1):
        expected = np.exp(log_softmax(class_scores(shared, own.before, own.pair[row], b2))) * n
        slots = np.exp(log_softmax(shared.slot + own.slot)) * m
        if step < steps:
            by_pair = np.zeros_like(pair)
            np.add.at(by_pair, row, expected)
            own.before += _moved(seen.sum(axis=0), expected.sum(axis=0), 4.0)
            own.pair += _moved(pair, by_pair, 4.0)
            own.slot += _moved(of_slot, slots, 2.0)
    out.bias += expected.sum(axis=0)
    out.skip[b2] += expected
    out.slot += slots


def _job(state: DataFrame, sizes: Sizes, shared: Shared, steps: int) -> tuple[DataFrame, Shared, DataFrame]:
    """One update: the state (before, counts, own) with its weights moved, the sums for the shared features (see ``_update``), and the files that hold both."""
    told = state.sparkSession.sparkContext.broadcast(shared.flat)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, any_ = Shared(sizes), Shared(sizes, told.value), False
        for batch in batches:
            for b1, counts, own in zip(*(c.to_pylist() for c in batch.columns)):
                any_, mine = True, Own(sizes, None if own is None else np.frombuffer(own, np.float32).astype(np.float64))
                _update(sizes, now, b1, np.frombuffer(counts, np.float32).astype(np.float64), mine, out, steps)
                yield pa.RecordBatch.from_arrays([pa.array([b1], pa.int32()), pa.array([counts], pa.binary()), pa.array([mine.flat.astype(np.float32).tobytes()], pa.binary())], ["before", "counts", "own"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([out.flat.tobytes()], pa.binary()), pa.array([None], pa.binary())], ["before", "counts", "own"])

    new = cut(state.mapInArrow(run, "before int, counts binary, own binary"))
    sums = [np.frombuffer(r.counts) for r in new.where("before < 0").select("counts").toLocalIterator()]
    told.destroy()
    return new.where("before >= 0"), Shared(sizes, np.sum([np.zeros_like(shared.flat), *sums], axis=0)), new


def train(cells: DataFrame, sizes: Sizes, updates: int = UPDATES) -> tuple[Shared, dict[int, np.ndarray]]:
    """The shared weights, and the own weights (float32) of each word before, after ``updates`` distributed gradient updates."""
    state, observed, files = _job(cells.coalesce(TASKS).withColumn("own", F.lit(None).cast("binary")), sizes, Shared(sizes), -1)
    shared = Shared(sizes)
    shared.bias[:] = np.log(observed.bias + PRIOR)
    shared.slot[:] = np.log(observed.slot + PRIOR)
    for _ in range(updates):
        old = files
        state, expected, files = _job(state, sizes, shared, STEPS)
        discard(old)
        together = np.where(np.arange(len(shared.flat)) < CLASSES * (sizes.buckets + 1), 4.0, 2.0)
        shared = Shared(sizes, shared.flat + _moved(observed.flat, expected.flat, together))
    own = {r.before: np.frombuffer(r.own, np.float32) for r in state.select("before", "own").toLocalIterator()}
    discard(files)
    return shared, own


class Model:
    """The weights as tasks score with them: those of all words before as rows of arrays."""

    def __init__(self, sizes: Sizes, shared: Shared, own: dict[int, np.ndarray]):
        rows = np.zeros((sizes.buckets, len(Own(sizes).flat)), np.float32)
        for b, x in own.items():
            rows[b] = x
        self.sizes, self.shared, self.rows = sizes, Shared(sizes, shared.flat), rows

    def class_rows(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of every class in contexts ``b1 * buckets + b2``."""
        b1, b2 = key // self.sizes.buckets, key % self.sizes.buckets
        pair = self.rows[:, CLASSES : CLASSES * (1 + self.sizes.pairs)].reshape(self.sizes.buckets, self.sizes.pairs, CLASSES)
        return log_softmax(class_scores(self.shared, self.rows[b1, :CLASSES], pair[b1, self.sizes.pair(b1, b2)], b2)) / np.log(10)

    def slot_rows(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of every slot of a class after a word, for ``class * buckets + b1``."""
        cls, b1 = key // self.sizes.buckets, key % self.sizes.buckets
        slot = self.rows[:, CLASSES * (1 + self.sizes.pairs) :].reshape(self.sizes.buckets, CLASSES, SLOTS)
        return log_softmax(self.shared.slot[cls] + slot[b1, cls]) / np.log(10)

    def of_tokens(self, t: Tokens) -> np.ndarray:
        """log10 probability of each token's class and slot."""

        def told(rows, key: np.ndarray, outcome: np.ndarray) -> np.ndarray:
            new, at = np.unique(key, return_inverse=True)
            out = np.empty(len(key))
            for i in range(0, len(new), 1 << 14):
                here = (at >= i) & (at < i + (1 << 14))
                out[here] = rows(new[i : i + (1 << 14)])[at[here] - i, outcome[here]]
            return out

        return told(self.class_rows, t.b1 * self.sizes.buckets + t.b2, t.cls) + told(self.slot_rows, t.cls * self.sizes.buckets + t.b1, t.slot)


def fit(training: DataFrame, text: str) -> tuple[DataFrame, Vocabulary, Model]:
    """The words' counts (word, cls, n), what of them is broadcast, and the model, from all rows of ``training``."""
    counts = cut(_count_words(training, text))
    own = _vocabulary(counts)
    vocabulary = training.sparkSession.sparkContext.broadcast(own)
    return counts, own, Model(own.sizes, *train(cut(_cells(training, text, vocabulary)), own.sizes))


def score(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document, trained on those not held out.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))); ``score`` is the model's log10 probability of the text and its end.  Null and empty texts
    have one token, the end.  Repeated rows count and are scored one by one; columns other than the two named are not read; an empty table gives an empty table.  If
    every document is held out, all words are unseen.  Words are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), is_held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts, own, fitted = fit(training, "text")
    shared = spark.sparkContext.broadcast((own, fitted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        for part, texts in slices(batches):
            t = Tokens(texts)
            vocab.look_up(t)
            rare = t.at < 0
            p = model.of_tokens(t)
            n = np.where(rare, 0, vocab.n[t.at] if len(vocab.n) else 0)
            counted = np.where(rare, 0.0, np.log10(n + ADD))
            p += np.where(t.own, 0.0, counted - vocab.inside[t.cls, t.slot])
            base = counted - vocab.base
            per = lambda x: pa.array(np.bincount(t.doc, weights=x, minlength=len(texts)))
            ints = lambda x: pa.array(np.bincount(t.doc[x], minlength=len(texts)).astype(np.int64))
            words = t.hash[rare].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(t.doc[rare], minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(t.n.astype(np.int64)), ints(~rare), per(base), per(p), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words))],
                ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "model", "rare"],
            )

    scored = rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, model double, rare array<bigint>")
    # One pass: a row for each rare word, and one for the document itself, whose key spreads and is never looked up.
    of = F.struct("doc_id", "held_out", "n_tokens", "n_frequent", "base", "model")
    parts = scored.select("row", F.explode(F.concat(F.array(F.struct(F.xxhash64("row").alias("key"), of.alias("doc"))), F.transform("rare", lambda w: F.struct(w.alias("key"), F.lit(None).cast("struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,n_frequent:bigint,base:double,model:double>").alias("doc"))))).alias("x")).select("row", "x.key", "x.doc")
    told = parts.join(counts.select(F.col("word").alias("key"), "n"), "key", "left")
    seen = F.col("doc").isNull() & F.col("n").isNotNull()
    sums = told.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sum(F.when(seen, 1).otherwise(0)).alias("known"),
        F.sum(F.when(seen, F.log10(F.col("n") + F.lit(ADD))).when(F.col("doc").isNull(), F.log10(F.lit(ADD))).otherwise(0.0)).alias("counted"),
    )
    return sums.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.n_frequent") + F.col("known")).alias("n_known"), F.lit(own.total).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("counted")).alias("base_score"), (F.col("doc.model") + F.col("counted")).alias("score"),
    )
