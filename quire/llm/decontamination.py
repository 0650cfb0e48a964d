"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items.

The automaton holds every run of words that occurs in an item.  Streaming a text's words through it gives, at each word, the longest run ending there that occurs in
some item; the words of every run of at least ``window`` words are hit, as are those of whole items that have fewer.  Its arrays are built in tasks, from parts of the
benchmark of a bounded number of words, and broadcast group by group; texts are passed once for each group, which is once but for very large benchmarks.

Words are found in numpy over the bytes of a whole batch.  Words that no item holds end a run, so only stretches of known words that are long enough to hold the
shortest window are streamed, side by side.  Words are compared as 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.shared import cut
from quire.llm.text_hash import SPAN, _tables, mix

#: Words that are hit at least in a row; items of fewer are matched as a whole.
WINDOW = 10
#: Words of a part of the benchmark, which makes one automaton (about 60 bytes a word), and parts that are broadcast together.
PART_WORDS, PARTS_AT_ONCE = 250_000, 4
#: A longer item is cut in pieces of this many words, each but the last followed by the first words of the next, so that every window is in one of them.
PIECE = 4096
#: Below this many stretches, they are streamed one by one.
FEW = 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: letters A-Z in lower case, digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


class Words:
    """Words of an Arrow column of texts: ``hash``, ``start`` and ``stop`` in the column's bytes, ``first`` (each text's first word, and at last the number of words), ``begin`` (each text's first byte)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        raw = raw[at[0] : at[-1]]
        self.begin = at - at[0]
        word = _IS_WORD[raw]
        opens, closes = word.copy(), np.zeros(len(raw) + 1, dtype=bool)
        edge = self.begin[(self.begin > 0) & (self.begin < len(raw))]
        if len(raw):
            opens[1:] &= ~word[:-1]
            opens[edge] = word[edge]
            closes[1:-1] = word[:-1] & ~word[1:]
            closes[edge] = word[edge - 1]
            closes[-1] = word[-1]
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, self.begin)
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.stop, self.start[i] + SPAN, side="right")))
            a, b = int(self.start[i]), int(self.stop[j - 1])
            power, inverse = _tables(b - a + 1)
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_FOLD[raw[a:b]].astype(np.uint64) + np.uint64(1)) * power[: b - a], dtype=np.uint64)])
                s, e = self.start[i:j] - a, self.stop[i:j] - a
                self.hash[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j


class Automaton:
    """The suffix automaton of items (label, word hashes), as arrays; ``least`` is the length of the shortest window.

    ``owners[pointer[s] : pointer[s + 1]]`` are the items (places in ``labels``) of which state s holds a window: that of ``window`` words, or the whole of a shorter
    item.  ``short[s]`` is the first state from s on along links that holds a whole shorter item, or -1; such an item is the longest run of its state, as nothing
    stands before it where it begins.
    """

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.labels = sorted({n for n, _ in items}, key=lambda n: (n is not None, n))
        place = {n: i for i, n in enumerate(self.labels)}
        items = [(place[n], h) for n, h in items]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *[h for _, h in items]]))
        sequences = [(n, np.searchsorted(self.vocabulary, h).tolist()) for n, h in items]
        step, link, length = [{}], [-1], [0]

        def extend(last: int, w: int) -> int:
            to = step[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                return to
            if to is None:
                new = len(step)
                step.append({}), link.append(0), length.append(length[last] + 1)
                at = last
                while at >= 0 and w not in step[at]:
                    step[at][w] = new
                    at = link[at]
                if at < 0:
                    return new
                to = step[at][w]
                if length[at] + 1 == length[to]:
                    link[new] = to
                    return new
            else:
                new, at = -1, last
            # The state is split: its shorter runs also end elsewhere now.
            copy = len(step)
            step.append(dict(step[to])), link.append(link[to]), length.append(length[at] + 1)
            while at >= 0 and step[at].get(w) == to:
                step[at][w] = copy
                at = link[at]
            link[to] = copy
            if new < 0:
                return copy
            link[new] = copy
            return new

        for _, words in sequences:
            last = 0
            for w in words:
                last = extend(last, w)
        self.link, self.length = np.array(link, np.int64), np.array(length, np.int64)
        by_length = np.argsort(self.length, kind="stable").tolist()
        # The state on the way along links that holds the run of exactly ``window`` words, if there is one.
        full = np.full(len(link), -1, np.int64)
        for s in by_length[1:]:
            full[s] = full[link[s]] if length[link[s]] >= window else s if length[s] >= window else -1
        self.full = full
        owned: dict[int, set[int]] = {}
        whole = np.zeros(len(link), bool)
        for n, words in sequences:
            s = 0
            for i, w in enumerate(words):
                s = step[s][w]
                if i + 1 >= window:
                    owned.setdefault(int(full[s]), set()).add(n)
            if 0 < len(words) < window:
                owned.setdefault(s, set()).add(n)
                whole[s] = True
        short = np.full(len(link), -1, np.int64)
        for s in by_length[1:]:
            short[s] = s if whole[s] else short[link[s]]
        self.short = short
        self.pointer = np.zeros(len(link) + 1, np.int64)
        for s, of in owned.items():
            self.pointer[s + 1] = len(of)
        self.pointer = np.cumsum(self.pointer)
        self.owners = np.array([n for s in sorted(owned) for n in sorted(owned[s])], np.int64)
        self.width = len(self.vocabulary) + 1
        pairs = sorted((s * self.width + w, to) for s, out in enumerate(step) for w, to in out.items())
        self.keys, self.to = np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)
        self.least = min([window, *[len(w) for _, w in sequences if len(w)]])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word among the items' words, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = state * self.width + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def advance(self, state: np.ndarray, run: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and lengths of the longest runs after one more word each."""
        state, run, todo = state.copy(), run.copy(), np.arange(len(state))
        while len(todo):
            to = self._next(state[todo], word[todo])
            found = to >= 0
            go = todo[found]
            state[go], run[go] = to[found], run[go] + 1
            todo = todo[~found]
            at_root = state[todo] == 0
            run[todo[at_root]] = 0
            todo = todo[~at_root]
            state[todo] = self.link[state[todo]]
            run[todo] = self.length[state[todo]]
        return state, run

    def stream(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest run at each word of the stretches [begin, end), which are all streamed at once, longest first."""
        states, runs = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, run = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        step = 0
        while len(begin):
            live = int(np.searchsorted(-size, -step, side="left"))
            begin, size, state, run = begin[:live], size[:live], state[:live], run[:live]
            if live <= FEW:
                break
            state, run = self.advance(state, run, word[begin + step])
            states[begin + step], runs[begin + step] = state, run
            step += 1
        for b, n, s, r in zip(begin.tolist(), size.tolist(), state.tolist(), run.tolist()):
            self._walk(word, b + step, b + n, s, r, states, runs)
        return states, runs

    def _walk(self, word: np.ndarray, at: int, end: int, state: int, run: int, states: np.ndarray, runs: np.ndarray) -> None:
        for i in range(at, end):
            key = int(word[i])
            while True:
                k = int(np.searchsorted(self.keys, state * self.width + key))
                if k < len(self.keys) and self.keys[k] == state * self.width + key:
                    state, run = int(self.to[k]), run + 1
                    break
                if not state:
                    run = 0
                    break
                state = int(self.link[state])
                run = int(self.length[state])
            states[i], runs[i] = state, run

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each occurrence of a window, in the order of ends: its last word, how many words are hit up to it, and the state that names its items."""
        known = self.known(words.hash)
        mine = np.flatnonzero(known >= 0)
        none = np.empty(0, np.int64)
        if not len(mine):
            return none, none, none
        text = np.searchsorted(words.first, mine, side="right")
        cuts = np.flatnonzero((np.diff(mine) != 1) | (np.diff(text) != 0)) + 1
        begin, end = mine[np.concatenate([[0], cuts])], mine[np.concatenate([cuts - 1, [len(mine) - 1]])] + 1
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none, none
        # The stretches alone, one after the other.
        size = end - begin
        offset = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(begin - offset[:-1], size) + np.arange(offset[-1])
        states, runs = self.stream(known[where], offset[:-1], offset[1:])
        found = np.flatnonzero(runs >= self.window)
        ends, reach, names = [where[found]], [runs[found]], [self.full[states[found]]]
        at = np.arange(len(states))
        s = self.short[states]
        while True:
            at, s = at[s >= 0], s[s >= 0]
            if not len(at):
                break
            fits = runs[at] >= self.length[s]
            ends.append(where[at[fits]]), reach.append(self.length[s[fits]]), names.append(s[fits])
            s = self.short[self.link[s]]
        ends, reach, names = np.concatenate(ends), np.concatenate(reach), np.concatenate(names)
        order = np.argsort(ends, kind="stable")
        return ends[order], reach[order], names[order]


def _spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of the intervals [first, last], as intervals."""
    order = np.lexsort((last, first))
    first, far = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > far[:-1] + 1])
    return list(zip(first[new].tolist(), far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(far) - 1]])].tolist()))


def _build(window: int):
    """Part by part, an automaton of its pieces."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        items = [(n, Words(pa.array([" ".join(words)])).hash) for n, words in zip(pieces["item"].tolist(), pieces["words"].tolist())]
        return pd.DataFrame({"part": [int(pieces["part"].iloc[0])], "automaton": [pickle.dumps(Automaton(items, window))]})

    return run


def _scan(told, texts: bool):
    """For each text: words, hit spans (words from and to, bytes from and to, all from 0, the byte after the last), and the items with windows in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = told.value
        for batch in batches:
            words = Words(batch.columns[-1])
            spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for a in automata:
                ends, reach, names = a.hits(words)
                for t, i, j in zip(*_groups(np.searchsorted(words.first, ends, side="right") - 1)):
                    spans[t] += _spans(ends[i:j] - reach[i:j] + 1, ends[i:j])
                    for s in np.unique(names[i:j]).tolist():
                        items[t].update(a.labels[n] for n in a.owners[a.pointer[s] : a.pointer[s + 1]].tolist())
            out = []
            for t, own in enumerate(spans):
                if len(automata) > 1 and own:
                    own = _spans(*np.array(own).T)
                w, b = int(words.first[t]), int(words.begin[t])
                out.append([{"first": f - w, "last": e - w, "from": int(words.start[f]) - b, "to": int(words.stop[e]) - b} for f, e in own])
            made = {"n_words": pa.array(np.diff(words.first), pa.int64()), "spans": pa.array(out, SPANS), "items": pa.array([sorted(x, key=lambda n: (n is not None, n)) for x in items], pa.list_(pa.string()))}
            kept = batch.columns if texts else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *made.values()], [*batch.schema.names[: len(kept)], *made])

    return run


SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "from", "to")]))
_SPANS = "array<struct<first:bigint,last:bigint,from:bigint,to:bigint>>"


def _groups(of: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Runs of equal numbers: the number, begin and end."""
    if not len(of):
        return [], [], []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    return of[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist()


def pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """part, item (its id as a string), words: the items, long ones in pieces.  Rows with the same id are one item, also those without any; items without words are left out."""
    rows = benchmark.select(F.col(_quoted(item)).cast("string").alias("item"), words_of(F.coalesce(F.col(_quoted(text)).cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    split = rows.select("item", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE))).alias("start"))
    split = split.select("item", "start", F.expr(f"slice(words, start + 1, {PIECE + window - 1})").alias("words")).where((F.col("start") == 0) | (F.size("words") >= window))
    split = cut(split)
    total = split.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    # Pieces are dealt by their hashes: about half of what a part may hold, so that none holds much more.
    parts = 1 if total <= PART_WORDS else -(-2 * total // PART_WORDS)
    return split.select(F.pmod(F.xxhash64("item", "start", "words"), F.lit(parts)).alias("part"), "item", "words")


def matches(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """The rows of docs as ``row`` (all columns but the text), ``text`` (left out unless ``texts``), ``n_words``, ``spans`` and ``items`` (ids as strings).

    A null or empty text has no words, spans or items; without items there are no spans.  Spans are runs of hit words, by words and by bytes of the UTF-8 text; those
    that touch are one.  Every row of docs is there once, whatever its id.
    """
    spark = docs.sparkSession
    automata = cut(pieces(benchmark, item, item_text, window).groupBy("part").applyInPandas(_build(window), "part long, automaton binary"))
    parts = [r.part for r in automata.select("part").orderBy("part").collect()] or [0]
    others = [F.col(_quoted(c)).alias(c) for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row") if others else F.lit(True).alias("row"), F.col(_quoted(text)).cast("string").alias("text"))
    for i in range(0, len(parts), PARTS_AT_ONCE):
        few = automata.where(F.col("part").isin(parts[i : i + PARTS_AT_ONCE])).orderBy("part").collect()
        told = spark.sparkContext.broadcast([pickle.loads(r.automaton) for r in few])
        more = i + PARTS_AT_ONCE < len(parts)
        kept = [f for f in rows.schema if f.name != "text" or texts or more]
        schema = StructType([*kept, *StructType.fromDDL(f"n_words bigint, spans {_SPANS}, items array<string>")])
        rows = rows.mapInArrow(_scan(told, texts or more), schema)
        if i:
            # What a further group of parts finds joins what those before have found.
            spans, items = F.array_sort(F.concat("spans", "row.spans")), F.array_sort(F.array_union("items", "row.items"))
            rows = rows.select("row.row", *(["text"] if texts or more else []), "n_words", _union(spans).alias("spans"), items.alias("items"))
        if more:
            rows = cut(rows).select(F.struct("row", "spans", "items").alias("row"), "text")
    return rows


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def decontaminated(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """docs without the spans of ``longest`` words or more that the benchmark holds; documents of whose words more than ``coverage`` are hit go whole.

    What stays around a span stays as it is.  Documents without words stay.  The columns are those of docs.
    """
    found = matches(docs, text, benchmark, item, item_text, window)
    clean = found.where((F.col("n_words") == 0) | (hit_words(F.col("spans")) <= coverage * F.col("n_words")))
    data = F.col("text").cast("binary")
    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))
    part = lambda a, n: F.substring(data, (a + 1).cast("int"), n.cast("int"))
    doomed = F.filter("spans", lambda x: x["last"] - x["first"] + 1 >= longest)
    left = F.aggregate(doomed, start, lambda s, x: F.struct(F.concat(s["out"], part(s["at"], x["from"] - s["at"])).alias("out"), x["to"].alias("at")))
    whole = F.when(F.size(doomed) == 0, F.col("text")).otherwise(F.concat(left["out"], part(left["at"], F.octet_length("text") - left["at"])).cast("string"))
    return clean.select(*[(whole if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _union(spans: Column) -> Column:
    """Sorted spans, with those that touch or overlap made one."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        merged = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))
        meets = F.coalesce(x["first"] <= last["last"] + 1, F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(_SPANS), step)


def report(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids in the order of strings, joined by commas), contaminated: one row a row of docs.

    An item without an id counts in n_items and is left out of the hash.
    """
    found = matches(docs.select(F.col(_quoted(doc_id)).alias("doc_id"), F.col(_quoted(text)).alias("text")), "text", benchmark, item, item_text, window, texts=False)
    hits = hit_words(F.col("spans"))
    return found.select(
        "row.doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated")
    )
