"""Rows of Spark and DuckDB results in a form that can be compared."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("PAGELOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, int, str, bytes)) or v is None:
        return v
    return str(v)


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df) -> list:
    return rows_of(df.columns, df.collect())


def duck(sql: str, **frames) -> list:
    c = duckdb.connect()
    for t in TABLES:
        if t not in frames and os.path.exists(f"{DATA}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, table in frames.items():
        c.register(name, table)
    r = c.sql(sql)
    return rows_of(r.columns, r.fetchall())
