"""Rows of a Spark query against rows of its SQL in DuckDB, by sorted column names and rounded values."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

from plinth.planview import TABLES


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        x = float(value)
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, query, oracle: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(oracle)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{name}: {len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else None
