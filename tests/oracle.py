"""Comparison of a Spark result with DuckDB's answer to the query's SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    return str(x)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """What differs, or the empty text."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    have = rows_of(df.columns, df.collect())
    if have == want:
        return ""
    return f"{sum(have.values())} rows, {sum(want.values())} expected; only here {list((have - want))[:3]}, only there {list((want - have))[:3]}"
