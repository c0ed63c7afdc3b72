"""A query's rows against those of its SQL twin, without regard to order."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal") else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(spark_df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert rows(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows(names, got.fetchall())
