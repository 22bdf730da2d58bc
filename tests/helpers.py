"""Comparing a Spark result with DuckDB over the same Parquet files."""

import datetime
import math
import os

import duckdb
import numpy as np


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.sql(f"create view \"{f.removesuffix('.parquet')}\" as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(spark, folder, name, query, sql):
    df = query(spark, folder)
    got = df.collect()
    want = duck(folder).sql(sql)
    columns, rows = want.columns, want.fetchall()
    assert sorted(columns) == sorted(df.columns), name
    assert rows_of(got, df.columns) == rows_of(rows, columns), name
