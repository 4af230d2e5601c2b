"""Compare a Spark result with DuckDB's, row by row, whatever the order."""

import glob
import os
from collections import Counter

import duckdb


def _plain(x):
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return round(x, 6) if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(_plain(r[i])) for i in order) for r in data)


def same(df, sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
