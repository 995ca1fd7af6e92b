"""Run a query in Spark and its SQL in DuckDB, and compare rows, names and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted((DATA / sf).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    """A value that sorts and compares alike from both engines."""
    if x is None:
        return (0,)
    if isinstance(x, bool):
        return (1, int(x))
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return (2, "nan") if math.isnan(x) else (1, float(f"{x:.9g}") + 0.0)
    if isinstance(x, int):
        return (1, float(f"{float(x):.9g}") if abs(x) < 2**53 else x)
    if isinstance(x, datetime.datetime):
        return (3, x.replace(tzinfo=None).isoformat())
    if isinstance(x, datetime.date):
        return (3, x.isoformat())
    if isinstance(x, (list, tuple)):
        return (4, tuple(plain(v) for v in x))
    if isinstance(x, dict):
        return (5, tuple((k, plain(v)) for k, v in sorted(x.items())))
    return (3, str(x))


def table(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty text if both give the same; else what differs first."""
    (names, rows), (names2, rows2) = of_spark(df), of_duckdb(con, sql)
    if names != names2:
        return f"columns {names} and {names2}"
    if len(rows) != len(rows2):
        return f"{len(rows)} and {len(rows2)} rows; {rows[:2]} and {rows2[:2]}"
    for a, b in zip(rows, rows2, strict=True):
        if not close(a, b):
            return f"{names}: {a} and {b}"
    return ""
