"""Order-dependent folds of keys that are too large for one task, whose state no short table can describe.

What a guarded ledger or a sliding window does in a bin of a key's order depends on the state that enters it, in as many ways as there are states.  But a bin can be
folded from a guess, and mostly the guess does not matter: after a few refusals, balances that began apart are the same, and a window forgets what is older.  So all
bins are folded side by side from guesses; a scan over the bins, which reads a row for each, passes on what left the bin before; and only bins that were entered
otherwise than guessed, in a way that matters, are folded again from what the scan says.  This is repeated until every bin was entered as it was folded, which is exact
whatever the data; at worst it takes a round for each bin.

For states that are numbers, a fold may tell how far a state can be moved, up or down, without changing any decision: the bin then only moves what leaves it as far.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.segmentation import BROADCAST_BINS, split_hot
from quire.staging import staged

_SUMMARY = "hot int, bin int, guess string, leaves string, down double, up double"


def _folded(values: list[str], step: Callable, slack: Callable | None, load: Callable, dump: Callable) -> Callable:
    """Each bin's summary after it was folded from its guess; a task holds one batch and one state."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, guess, down, up = None, None, None, 0.0, 0.0
        for batch in batches:
            out = []
            for hot, own, told, value in zip(batch["hot"].tolist(), batch["bin"].tolist(), batch["guess"].tolist(), zip(*[batch[v].tolist() for v in values])):
                if (hot, own) != at:
                    if at is not None:
                        out.append((*at, guess, dump(state), down, up))
                    at, state, guess, down, up = (hot, own), load(told), told, np.inf if slack else 0.0, np.inf if slack else 0.0
                if slack:
                    less, more = slack(state, *value)
                    down, up = min(down, less), min(up, more)
                state, _ = step(state, *value)
            yield pd.DataFrame(out, columns=_NAMES)
        if at is not None:
            yield pd.DataFrame([(*at, guess, dump(state), down, up)], columns=_NAMES)

    return run


_NAMES = ["hot", "bin", "guess", "leaves", "down", "up"]


def _scanned(start: str, moves: bool) -> Callable:
    """What enters each bin, and whether it is entered as it was folded.  After a bin that is not, what left it before is passed on as the next guess."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.hot != hot:
                    hot, state = row.hot, start
                fits, leaves = state == row.guess, row.leaves
                if not fits and moves:
                    by = json.loads(state) - json.loads(row.guess)
                    if -row.down <= by <= row.up:
                        fits, leaves = True, json.dumps(json.loads(row.leaves) + by)
                out.append((row.hot, row.bin, state, fits))
                state = leaves
            yield pd.DataFrame(out, columns=["hot", "bin", "entering", "fits"])

    return run


def speculated(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable, step: Callable, fold: Callable, hot_rows: int | None = None,
    slack: Callable | None = None, load: Callable = json.loads, dump: Callable = json.dumps,
) -> DataFrame:
    """rows with what ``fold(rows, keys)`` gives, which begins each key with the state in the column ``entering``; keys with many rows over many tasks.

    ``step`` and ``start`` are those of the fold; ``slack(state, *values)`` tells how far the state may be lowered and raised before this row is decided otherwise;
    ``dump`` and ``load`` turn a state to a string, equal states to equal ones, and back.
    """
    first = dump(start())
    cold, own, bins = split_hot(rows, keys, order, hot_rows)
    out = fold(cold.withColumn("entering", F.lit(first)), keys)
    columns = [c for c in out.columns if c != "entering"]
    if own is None:
        return out.select(*columns)
    small = lambda told: F.broadcast(told) if bins <= BROADCAST_BINS else told  # noqa: E731  a row a bin
    narrow = own.select("hot", "bin", *dict.fromkeys([*order, *values]))
    run, scan = _folded(values, step, slack, load, dump), _scanned(first, slack is not None)
    guesses, done = None, None
    while True:
        part = narrow.withColumn("guess", F.lit(first)) if guesses is None else narrow.join(small(guesses), ["hot", "bin"])
        new = part.repartition("hot", "bin").sortWithinPartitions("hot", "bin", *order).mapInPandas(run, _SUMMARY)
        done = staged(new if done is None else done.join(guesses, ["hot", "bin"], "left_anti").unionByName(new))
        told = staged(done.repartition("hot").sortWithinPartitions("hot", "bin").mapInPandas(scan, "hot int, bin int, entering string, fits boolean"))
        guesses = told.where(~F.col("fits")).select("hot", "bin", F.col("entering").alias("guess"))
        if guesses.isEmpty():
            break
    hot = fold(own.join(small(told.drop("fits")), ["hot", "bin"]), ["hot", "bin"])
    return out.select(*columns).unionByName(hot.select(*columns))
