"""Compares registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    types = dict(df.dtypes)
    wrong = {n: (types[n], k) for n, k in zip(names, kinds) if KIND.get(types[n], types[n]) != k}
    if wrong:
        return f"types {wrong}"
    order = sorted(names)
    ours = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    at = [names.index(n) for n in order]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in theirs)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ, first {order}: {bad[0]}" if bad else None
