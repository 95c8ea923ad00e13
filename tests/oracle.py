"""Spark rows against DuckDB rows: names, counts and values, in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(spark_rows, sql_rows):
    a, b = _ordered(spark_rows), _ordered(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for c in a.columns:
        kinds = (pd.api.types.is_float_dtype(a[c]), pd.api.types.is_float_dtype(b[c]))
        if kinds[0] != kinds[1]:
            return f"{c}: {a[c].dtype} and {b[c].dtype}"
        differ = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        if differ.any():
            k = differ.idxmax()
            return f"{c}: {differ.sum()} rows, first {a.loc[k].to_dict()} and {b.loc[k].to_dict()}"
    return ""
