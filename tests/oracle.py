"""Runs a query's SQL on DuckDB and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


def assert_same(df, con, sql):
    got = df.collect()
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want)
