"""Comparison of a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value) if value == value else None
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return int(value)
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([(columns[i], plain(r[i])) for i in order]) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    assert got == want
