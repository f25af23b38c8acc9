"""Comparison of a query's rows with its SQL's rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    return sorted(r.columns), rows(list(r.columns), r.fetchall())


def check(query, sql, spark, sf_dir):
    df = query(spark, sf_dir)
    columns, want = expected(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert rows(df.columns, df.collect()) == want
