"""Holds a Spark result against DuckDB's, row by row and without order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def one(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False))


def duck(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con.sql(sql).df()


def check(spark, query, sql: str, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), duck(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
