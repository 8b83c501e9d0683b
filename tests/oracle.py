"""Spark results against DuckDB's, regardless of row order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, d, f, sql):
    df = f(spark, d)
    mine, cols = rows_of(df.columns, df.collect())
    rel = connect(d).sql(sql)
    theirs, other = rows_of(rel.columns, [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in rel.fetchall()])
    assert cols == other, (cols, other)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(mine)
