"""Runs a query's SQL in DuckDB over the same parquet files and brings both results to one form."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x: object) -> str:
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    q = con.execute(sql)
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in q.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want
