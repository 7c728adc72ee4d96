"""Compare a query with its SQL over the smallest tables."""

import os

import duckdb

DIRECTORY = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for file in os.listdir(DIRECTORY):
        path = f"{DIRECTORY}/{file}"
        con.execute(f"create view {file.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return "nan" if value != value else f"{float(value):.6f}"
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


def assert_same(spark, query, sql):
    got = query(spark, DIRECTORY)
    con = connect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
