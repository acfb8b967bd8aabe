"""Compares a query's rows with those of its SQL in DuckDB, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value as both engines give it: numbers rounded to nine digits, times without a zone, nested values as tuples."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(a, b, tolerance=1e-6):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tolerance) for x, y in zip(a, b))
    return a == b


def duck(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def check(df, folder: str, sql: str) -> int:
    """Asserts that the query and its SQL agree; the number of rows."""
    ours, theirs = rows_of(df.columns, df.collect()), duck(folder, sql)
    assert sorted(df.columns) == sorted(theirs[0])
    theirs = rows_of(*theirs)
    assert len(ours) == len(theirs), f"{len(ours)} rows, SQL {len(theirs)}"
    for a, b in zip(ours, theirs):
        assert same(a, b), f"{a} is not {b}"
    return len(ours)
