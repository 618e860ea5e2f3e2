"""Rows of a query and of its SQL in DuckDB, compared without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cell(x) -> str:
    if x is None or isinstance(x, float) and x != x:
        return "NULL"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(cell(y) for y in x) + "]"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(table) -> list[str]:
    cols = sorted(table.column_names)
    return sorted("|".join(cell(x) for x in r) for r in zip(*(table[c].to_pylist() for c in cols)))


def oracle(c: duckdb.DuckDBPyConnection, sql: str):
    t = c.sql(sql).arrow()
    return t.read_all() if hasattr(t, "read_all") else t


def check(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    ours, theirs = df.toArrow(), oracle(c, sql)
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
