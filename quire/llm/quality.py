"""Quality classifier by weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

Labellers vote fit, unfit or abstain on each document.  All documents are counted by the pattern of their votes (at most
3 ** labellers patterns), and expectation-maximisation on those counts estimates how often each labeller casts which vote on fit and on
unfit documents, and so the probability that a document with a pattern is fit.  These posteriors are the labels of a logistic
regression on hashed features (words, character trigrams, shapes and binned measures of whole texts), which scores every document.  No hand-made label is used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.text_hash import Words, mix

FIT, UNFIT, ABSTAIN = "1", "0", "-"
#: Hash buckets of the scorer's features.
BUCKETS = 1 << 14
#: Documents that the scorer is fitted on, at most about so many: those with the smallest hashes of their text.
FITTED = 8_000
EM_ROUNDS, EPOCHS, RATE, DECAY, SEED = 50, 12, 0.5, 1e-5, 7

# Frequent function words of the corpus's languages (English, German, French, Spanish).
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on with as be at by this are from or an not have which und der die das den von zu mit ist ein eine auf im dem nicht für sich auch "
    "le la les de des et un une du en que est dans pour qui sur au pas par plus el los las y del se por con para no es su lo al como".split()
)
_SYMBOL = re.compile(r"[^\w\s.,;:'\"?()\-]")


def measures(text: str) -> dict[str, float] | None:
    """What the labellers look at; None for a text without words."""
    words = text.split()
    if not words:
        return None
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    again = sum(map(str.__eq__, words, words[1:]))
    known = sum(counts[w] for w in FUNCTION_WORDS if w in counts)
    pairs = len(set(zip(words, words[1:])))
    return {
        "words": n, "distinct": len(counts) / n, "top": counts.most_common(1)[0][1] / n, "again": again / n, "pairs": pairs / max(1, n - 1),
        "upper": upper / n, "symbols": len(_SYMBOL.findall(text)) / n, "known": known / n, "ends": sum(x.rstrip()[-1] in ".!?…\"" for x in lines) / len(lines),
        "bars": (text.count("|") + text.count("***")) / n, "length": (len(text) - n + 1) / n, "lines": len(set(lines)) / len(lines),
    }


def _between(unfit_to: float, fit_from: float):
    """A labeller of a measure that is low in unfit texts."""
    return lambda x: UNFIT if x < unfit_to else FIT if x >= fit_from else ABSTAIN


def _above(fit_to: float, unfit_from: float):
    """A labeller of a measure that is high in unfit texts."""
    return lambda x: FIT if x <= fit_to else UNFIT if x > unfit_from else ABSTAIN


#: Name, measure, least words for a vote, rule.
LABELLERS = [
    ("repeats a word at once", "again", 10, _above(0.08, 0.2)),
    ("few different word pairs", "pairs", 30, _between(0.4, 0.75)),
    ("one word dominates", "top", 20, _above(0.15, 0.3)),
    ("shouts", "upper", 5, _above(0.1, 0.5)),
    ("symbols", "symbols", 5, _above(0.1, 0.4)),
    ("function words", "known", 20, _between(0.03, 0.12)),
    ("lines end as sentences", "ends", 10, _between(0.3, 0.7)),
    ("tables and rulers", "bars", 5, _above(0.02, 0.25)),
    ("word length", "length", 5, lambda x: FIT if 3 <= x <= 9 else UNFIT if x > 15 or x < 1.8 else ABSTAIN),
]


def votes(m: dict[str, float] | None) -> str:
    """One vote a labeller; a text without words gets the vote unfit from all."""
    if m is None:
        return UNFIT * len(LABELLERS)
    return "".join(rule(m[name]) if m["words"] >= least else ABSTAIN for _, name, least, rule in LABELLERS)


def em(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], float, list[dict[str, tuple[float, float]]]]:
    """Posterior of fit for each vote pattern, the share of fit documents, and each labeller's vote rates (unfit, fit).

    Labellers are taken as independent given the class.  It starts from their majority; a vote's rate is smoothed by one document.
    """
    posterior = {p: (p.count(FIT) + 1 - 1.5 * (p.count(UNFIT) > 0)) / (p.count(FIT) + p.count(UNFIT) + 1) if p.count(UNFIT) < 2 else 0.05 for p in patterns}
    posterior = {p: min(0.95, max(0.05, x)) for p, x in posterior.items()}
    total, share, rates = sum(patterns.values()), 0.5, []
    for _ in range(rounds):
        fit = sum(n * posterior[p] for p, n in patterns.items())
        share = min(1 - 1e-6, max(1e-6, fit / max(1, total)))
        rates = []
        for k in range(len(LABELLERS)):
            of = {v: [1.0, 1.0] for v in (FIT, UNFIT, ABSTAIN)}
            for p, n in patterns.items():
                of[p[k]][1] += n * posterior[p]
                of[p[k]][0] += n * (1 - posterior[p])
            rates.append({v: (u / (total - fit + 3), f / (fit + 3)) for v, (u, f) in of.items()})
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[k][v][1] / rates[k][v][0]) for k, v in enumerate(p) if v != ABSTAIN)
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, share, rates


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


_SHAPE = str.maketrans({c: "x" for c in map(chr, range(97, 123))} | {c: "X" for c in map(chr, range(65, 91))} | {c: "9" for c in "0123456789"})
_RUNS = re.compile(r"(.)\1+")


#: What the seed of a feature's hash is mixed with, so that words and trigrams fall on buckets of their own.
_WORDS, _TRIGRAMS = np.uint64(0x51ED270B), np.uint64(0x2545F491)


def _shares(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The share of the hashes that falls on each bucket."""
    return np.bincount((mix(hashes ^ seed) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS) / max(1, len(hashes))


def features(text: str, m: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text: a bias, binned measures, and shares of words, of character (byte) trigrams and of words' first and last characters."""
    out = _shapes(text, m)
    x = np.zeros(BUCKETS)
    if m is not None:
        raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
        x += _shares(Words([text]).hash, _WORDS) + _shares((raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:], _TRIGRAMS)
    x[list(out)] += list(out.values())
    at = np.flatnonzero(x)
    return at, x[at]


def _shapes(text: str, m: dict[str, float] | None) -> dict[int, float]:
    out = {_bucket("bias"): 1.0}
    if m is None:
        out[_bucket("empty")] = 1.0
        return out
    for name, x in m.items():
        bin_ = int(math.log2(x + 1) * 2) if name in ("words", "length") else int(x * 12) if x < 1 else 12
        b = _bucket(f"{name}={bin_}")
        out[b] = out.get(b, 0.0) + 1.0
    ends = Counter(w[0].translate(_SHAPE) + w[-1].translate(_SHAPE) for w in text.split())
    for shape, n in ends.items():
        b = _bucket(f"ends {shape}")
        out[b] = out.get(b, 0.0) + n / m["words"]
    return out


def _fit(examples: list[tuple[bytes, bytes, float]]) -> np.ndarray:
    """Weights of the scorer: logistic regression on soft labels, by stochastic gradients with adaptive rates."""
    w, seen, random = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), np.random.default_rng(SEED)
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for i, x, y in examples]
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            i, x, y = rows[k]
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x))))) - y) * x + DECAY * w[i]
            seen[i] += g * g
            w[i] -= RATE * g / np.sqrt(seen[i])
    return w


def _rows(docs: DataFrame, text: str, make, schema: str, types: pa.Schema) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [make(t or "") for t in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x, f.type) for x, f in zip(zip(*made), types))], names=[*part.schema.names[:-1], *types.names])

    return docs.select(*[c for c in docs.columns if c != text], text).mapInArrow(run, schema)


def fit(docs: DataFrame, text: str, fitted: int = FITTED) -> dict:
    """The model: scorer weights ``w``, pattern posteriors, the share of fit documents and the labellers' vote rates.

    The vote counts and the EM cover all documents, repeated rows as often as they are there and null texts as empty ones.  The linear scorer is fitted on about ``fitted`` of
    them, each text once.  The model is the same however the rows are dealt to tasks; without rows it scores every text alike.
    """
    only = docs.select(F.col(text).alias("__text"))
    voted = _rows(only, "__text", lambda t: (votes(measures(t)),), "votes string", pa.schema([("votes", pa.string())]))
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, share, rates = em(patterns)
    total = sum(patterns.values())
    drawn = only.where(F.pmod(F.xxhash64("__text"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, fitted / max(1, total)))))

    def example(t: str) -> tuple:
        m = measures(t)
        i, x = features(t, m)
        return i.astype(np.int32).tobytes(), x.astype(np.float32).tobytes(), posterior[votes(m)]

    types = pa.schema([("i", pa.binary()), ("x", pa.binary()), ("y", pa.float64())])
    rows = _rows(drawn.dropDuplicates(), "__text", example, "i binary, x binary, y double", types).collect()
    return {"w": _fit(sorted((r.i, r.x, r.y) for r in rows)), "posterior": posterior, "share": share, "rates": rates}


def _scorer(spark: SparkSession, model: dict, least: float):
    shared = spark.sparkContext.broadcast((model["w"], model["posterior"]))

    def scored(t: str) -> tuple:
        w, posterior = shared.value
        m = measures(t)
        i, x = features(t, m)
        s = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x)))))
        return s, posterior.get(votes(m), 0.5), s >= least

    return scored


def score(docs: DataFrame, doc_id: str, text: str, model: dict, least: float = 0.5) -> DataFrame:
    """doc_id, ``score`` (probability of fit), ``posterior`` (of the labellers alone) and ``keep`` (score >= least) of every row.

    A null text counts as empty and is unfit; null ids and repeated rows stay; other columns are not read.
    """
    types = pa.schema([("score", pa.float64()), ("posterior", pa.float64()), ("keep", pa.bool_())])
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    out = _rows(rows, "__text", _scorer(docs.sparkSession, model, least), f"__id {kind}, score double, posterior double, keep boolean", types)
    return out.select(F.col("__id").alias(doc_id), "score", "posterior", "keep")


def kept(docs: DataFrame, text: str, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all of their columns, whatever their names; repeated rows stay or go together, null texts go as unfit."""
    scored = _scorer(docs.sparkSession, model, least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array([scored(t or "")[2] for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
