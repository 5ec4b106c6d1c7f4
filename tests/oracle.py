"""Comparing a query with its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(df, sql, con):
    rel = con.sql(sql)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(rel.columns, rel.fetchall())
