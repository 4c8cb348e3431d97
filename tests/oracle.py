"""Comparison of a Spark result with SQL over the same tables."""

import decimal
import glob
import math

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(value(r[i]) for i in at) for r in res.fetchall()), key=str)
    assert got == want
