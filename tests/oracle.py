"""Compares registered queries with their SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import glob
import os

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        inside = "/*.parquet" if os.path.isdir(f) else ""
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{inside}')")
    return c


def same(spark, d: str, query, sql: str) -> None:
    df = query(spark, d)
    names = sorted(df.columns)
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    found = tables(d).execute(sql)
    have = [x[0] for x in found.description]
    assert sorted(have) == names
    want = sorted(tuple(str(r[have.index(n)]) for n in names) for r in found.fetchall())
    assert got == want
