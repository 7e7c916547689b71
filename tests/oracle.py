"""Comparing a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def connection(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, int | float) and not isinstance(v, bool):
        return repr(round(float(v), 9))
    return str(v)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)), sorted(df.columns)


def same(spark_df, sql, sf_dir):
    ours, theirs = plain(spark_df.toPandas()), plain(connection(sf_dir).sql(sql).fetchdf())
    assert ours[1] == theirs[1]
    assert len(ours[0]) == len(theirs[0])
    assert ours[0] == theirs[0]
