"""Runs a query and its SQL on the same parquet tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(plain(row[i]) for i in order)) for row in r.fetchall())
    assert ours == theirs
