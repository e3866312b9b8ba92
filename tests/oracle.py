"""Runs a query and its SQL on one folder of tables and compares rows, whatever their order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else float(v) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted([tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)], key=repr)


def same(spark, run, sql, folder=SMALL):
    got, want = run(spark, folder).toPandas(), duck(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
