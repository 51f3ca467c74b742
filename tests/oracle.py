"""Runs a query's SQL in DuckDB and compares rows without regard to their order."""

import decimal
import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (numbers.Number, decimal.Decimal)):
        return f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v.tolist() if hasattr(v, "tolist") else v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def assert_same(query, sql: str, spark, sf_dir: str) -> int:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
