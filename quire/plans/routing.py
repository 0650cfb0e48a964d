"""Batches of turns through a stand-in for a translating service, with its failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import routing
from quire.operators.jobs import FAILED_MARK
from quire.plans.registry import query
from quire.sources.tables import table
from quire.staging import folder

BUDGETS = [600, 300]
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def told(text: Column) -> Column:
    """The stand-in's translation: capitals, but for texts of a length that 5 divides, which it leaves as they are."""
    return F.when(F.length(text) % 5 == 0, text).otherwise(F.translate(text, LOWER, UPPER))


def batch(sent: Column) -> Column:
    """It fails where the request's length is divisible by 11, and forgets every third segment."""
    parts = lambda group: F.regexp_extract_all(sent, F.lit(r'(?s)<seg id="(\d+)">(.*?)</seg>'), F.lit(group))
    pairs = F.filter(F.arrays_zip(parts(1).alias("at"), parts(2).alias("text")), lambda p: p["at"].cast("int") % 3 != 0)
    return F.when(F.length(sent) % 11 != 0, routing.request(F.transform(pairs, lambda p: F.struct(p["at"].alias("at"), told(p["text"]).alias("text")))))


def alone(text: Column, strength: int) -> Column:
    """It fails where the text's length is divisible by 7; asked again, it translates texts of even length wholly."""
    again = F.when(F.length(text) % 2 == 0, F.translate(text, LOWER, UPPER)).otherwise(told(text))
    return F.when(F.length(text) % 7 != 0, told(text) if strength == 1 else again)


def residue(text: Column) -> Column:
    """Words of three and more small letters."""
    return F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0))


def _routes_sql() -> str:
    """A recursive walk for the batches of each attempt, over the rows that the one before has left."""
    size = f"ceil(length(regexp_replace(text, '[^{X.CJK}]', '', 'g')) / 2 + (length(text) - length(regexp_replace(text, '[^{X.CJK}]', '', 'g'))) / 4)::BIGINT"
    trim = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    said = f"translate(text, '{LOWER}', '{UPPER}')"
    first = f"CASE WHEN length(text) % 5 = 0 THEN text ELSE {said} END"
    again = f"CASE WHEN length(text) % 2 = 0 THEN {said} ELSE {first} END"
    left = lambda x: f"len(regexp_extract_all({x}, '[a-z]{{3,}}'))"
    one = f"CASE WHEN length(text) % 7 <> 0 THEN {trim.format(f'CASE WHEN {left(first)} > 0 AND {left(again)} < {left(first)} THEN {again} ELSE {first} END')} END"
    steps, source = [], r"(SELECT conv_id, turn, text FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\s', ' ', 'g')) <> '')"
    for n, budget in enumerate(BUDGETS, 1):
        steps.append(f"""
        r{n} AS (SELECT conv_id, turn, text, {size} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {source}),
        f{n} AS (
            SELECT *, 1 AS batch, size AS full FROM r{n} WHERE k = 1
            UNION ALL
            SELECT r.*, CASE WHEN f.full + r.size > {budget} THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.full + r.size > {budget} THEN r.size ELSE f.full + r.size END
            FROM f{n} f JOIN r{n} r ON r.conv_id = f.conv_id AND r.k = f.k + 1),
        b{n} AS (SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY k) AS seq, count(*) OVER (PARTITION BY conv_id, batch) AS rows FROM f{n}),
        q{n} AS (SELECT *, sum(length('<seg id="' || seq || '">' || text || '</seg>') + 1) OVER (PARTITION BY conv_id, batch) - 1 AS sent FROM b{n}),
        a{n} AS (
            SELECT conv_id, turn, text, CASE WHEN rows = 1 THEN {one} WHEN sent % 11 <> 0 AND seq % 3 <> 0 AND {left(first)} = 0 THEN {trim.format(first)} END AS translated,
                   CASE WHEN rows = 1 THEN 'single' ELSE 'batch' END AS route FROM q{n})""")
        source = f"a{n} WHERE translated IS NULL"
    last = len(BUDGETS) + 1
    found = [f"SELECT conv_id, turn, translated, route, {n}::INTEGER AS attempt FROM a{n} WHERE translated IS NOT NULL" for n in range(1, last)]
    blank = r"SELECT conv_id, turn, '' AS translated, 'blank' AS route, 1 AS attempt FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\s', ' ', 'g')) = ''"
    rest = f"SELECT conv_id, turn, coalesce({one}, '{FAILED_MARK}') AS translated, CASE WHEN {one} IS NULL THEN 'marker' ELSE 'retry' END AS route, {last} AS attempt FROM {source}"
    return f"WITH RECURSIVE {','.join(steps)} {' UNION ALL '.join([blank, *found, rest])}"


@query(_routes_sql())
def routed_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's translation, how it came about and at which attempt; batches are dealt anew among what the attempt before has left."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return routing.translated(rows, ["conv_id"], ["turn"], "text", BUDGETS, batch, alone, residue, folder(spark)).drop("text")
