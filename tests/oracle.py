"""Compares a query with its SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c.sql(sql).df()


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted(map(tuple, zip(*[df[c].map(_plain) for c in sorted(df.columns)], strict=True)))


def check(query, sql: str, spark, folder: str) -> None:
    a, b = query(spark, folder).toPandas(), run_sql(sql, folder)
    assert sorted(a.columns) == sorted(b.columns)
    # A whole column of numbers may be floats on one side because of nulls.
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and {a[c].dtype.kind, b[c].dtype.kind} <= set("iuf"):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert rows(a) == rows(b)
