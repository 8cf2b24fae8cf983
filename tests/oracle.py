"""Compares a query's rows with those of its SQL in DuckDB, in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if not isinstance(v, (int, Decimal)) or isinstance(v, bool):  # texts, dates, times, bytes, nulls
        return str(v)
    return repr(round(float(v), 6) + 0.0)


def same_rows(df, con, sql):
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    theirs_names = [x[0] for x in found.description]
    assert sorted(theirs_names) == names
    order = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert ours == theirs
