"""Compares a query with its SQL, as sets of rows with columns sorted by name."""

from __future__ import annotations

import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(directory)):
        path = os.path.join(directory, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.6f}") + 0.0
    return str(value) if type(value).__name__ == "Decimal" else value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark_df, con, sql: str) -> str:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows(names, got.fetchall())
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(names)} and {sorted(spark_df.columns)}"
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; only ours {list(a - b)[:2]}; only theirs {list(b - a)[:2]}"
