"""Spark rows against DuckDB rows of the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]) and df[c].isna().any():  # pandas has these as floats from Spark
            df[c] = df[c].astype("float64")
        df[c] = df[c].round(5) if df[c].dtype.kind == "f" and df[c].notna().any() else df[c].astype(object).where(df[c].notna(), None).map(
            lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(con, frame, sql):
    got, want = normal(frame.toPandas()), normal(con.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-5)
