"""Ledgers: running balances, guarded debits, credits that count once."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import ordered_fold
from quire.operators.speculation import speculated


def running_balance(entries: DataFrame, user: str, order: list[str], amount: str, opening: int = 1000) -> DataFrame:
    """entries with ``balance_after``, every one applied."""
    at = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance_after", (F.lit(opening) + F.sum(amount).over(at)).cast("long"))


def guarded(entries: DataFrame, user: str, order: list[str], amount: str, opening: int = 1000, hot_rows: int | None = None) -> DataFrame:
    """entries with ``accepted`` and ``balance_after``: a debit larger than the balance is refused and changes nothing.

    Folded in order for each user, since a refusal depends on the balance that earlier refusals left; a user of more than ``hot_rows`` entries is folded in bins from
    guessed balances, which are made good (``operators/speculation.py``).
    """

    def step(balance: int, x: int) -> tuple:
        fits = x >= 0 or balance >= -x
        balance += x if fits else 0
        return balance, (fits, balance)

    def slack(balance: int, x: int) -> tuple:
        if x >= 0:
            return math.inf, math.inf
        return (balance + x, math.inf) if balance >= -x else (math.inf, -x - balance - 1)

    def begin(balance: int | None, x: int, entering: str) -> tuple:
        return step(json.loads(entering) if balance is None else balance, x)

    def fold(part: DataFrame, keys: list[str]) -> DataFrame:
        return ordered_fold(part, keys, order, [amount, "entering"], lambda: None, begin, "accepted boolean, balance_after bigint")

    return speculated(entries, [user], order, [amount], lambda: opening, step, fold, hot_rows, slack)


def once_each(credits: DataFrame, payment: str, order: list[str]) -> DataFrame:
    """The first credit of each payment; credits without a payment all count."""
    first = F.row_number().over(Window.partitionBy(payment).orderBy(*order)) == 1
    named = credits.where(F.col(payment).isNotNull()).withColumn("first", first).where("first").drop("first")
    return named.unionByName(credits.where(F.col(payment).isNull()))


def history(entries: DataFrame, user: str, order: list[str], n: int = 50) -> DataFrame:
    """The newest n entries of each user; ties to the larger id by ``order``."""
    at = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return entries.withColumn("n", F.row_number().over(at)).where(F.col("n") <= n).drop("n")
