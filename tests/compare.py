"""Runs a query and its SQL twin and compares them as bags of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def twin(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    return names, done.fetchall()


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, expected = twin(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
