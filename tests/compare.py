"""Holds a query's rows against its SQL: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if x != x else x + 0.0
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_value(r[k]) for k in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]}, not {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows, not {len(want[1])}"
    odd = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    return f"{len(odd)} of {len(want[1])} rows differ, as {odd[0]}" if odd else ""
