"""Holds a query's rows against DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, con, sql):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert ours == theirs
