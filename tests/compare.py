"""Runs a query and its SQL over the same tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def normal(v) -> str:
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{normal(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def check(spark, query, sql) -> None:
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(normal(r[n]) for n in names) for r in df.collect())
    if sql is None:
        return
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.sql(sql)
    assert sorted(found.columns) == names
    places = [found.columns.index(n) for n in names]
    assert got == sorted(tuple(normal(r[p]) for p in places) for r in found.fetchall())
