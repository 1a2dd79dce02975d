"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import datetime
    import decimal
    import math

    if isinstance(v, (decimal.Decimal,)):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> str | None:
    """None if rows are equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    return next((f"{g!r:.200}, expected {w!r:.200}" for g, w in zip(got, want) if g != w), None)
