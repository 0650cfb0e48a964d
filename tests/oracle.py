"""Comparison of a query's rows with those of its DuckDB SQL."""

import datetime
import glob
import math
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or isinstance(x, (str, bool, bytes, int, datetime.datetime, datetime.date)):
        return x
    if isinstance(x, float):
        return float(f"{x:.10g}") if math.isfinite(x) else str(x)
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_plain(v[i]) for i in order) for v in values], key=repr)


def same(df, con, sql):
    found = con.sql(sql)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
