"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return None if value is None else str(value)


def rows(values, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


def same(df, sql, con):
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), list(result.columns))
