"""Comparison of a Spark result with the SQL that states it."""

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("FRAMELOOM_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def sql_rows(text, columns):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    c = con.execute(text)
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(x) for x in sorted(columns)]
    return Counter(repr(tuple(plain(r[i]) for i in at)) for r in c.fetchall())


def spark_rows(df):
    cols = sorted(df.columns)
    return Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
