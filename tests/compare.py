"""Comparing a query's rows with those of its SQL in DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, decimal.Decimal, np.number)):
        return float(v) + 0.0
    return str(v)


def rows(records, columns, order):
    return sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in records)


def same(df, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns, order) == rows(got.fetchall(), names, order)
