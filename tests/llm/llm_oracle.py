"""Rows of a DataFrame and of DuckDB, in a form that can be compared."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(canon(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(canon(v) for v in r) for r in frame.select(*names).collect()), key=repr)
