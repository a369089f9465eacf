"""Comparison of a query's rows with DuckDB's, as sets of values."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{source}'")
    return con


def rows(pdf) -> list[str]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).values.tolist()))


def check(spark, query, sql: str, folder: str = DATA) -> None:
    got, want = query(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
