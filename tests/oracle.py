"""Runs a query and its SQL on the same tables and compares them as multisets of rows."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float) and x == 0:
        return 0.0
    return x


def compare(spark, con, name, function, sql, sf_dir):
    got = function(spark, sf_dir)
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names), (name, got.columns, names)
    order = sorted(names)
    a = sorted(str([plain(r[n]) for n in order]) for r in got.collect())
    b = sorted(str([plain(dict(zip(names, r, strict=True))[n]) for n in order]) for r in want.fetchall())
    assert len(a) == len(b), (name, len(a), len(b), a[:2], b[:2])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:2])
    return len(a)
