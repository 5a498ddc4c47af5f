"""Rows of a query held against rows of SQL, as the driver does: columns by name, rows in any order."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6f}" if not isinstance(v, (str, bool)) and pd.api.types.is_number(v) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, sql: str, folder: str) -> None:
    got, want = spark_df.toPandas(), connect(folder).execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
