"""Runs registered queries against their SQL in DuckDB."""

import datetime as dt
import decimal
import math
import os

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir, fn, sql, con=None):
    """None when equal, else a description of the difference."""
    con = con or connect(sf_dir)
    df = fn(spark, sf_dir)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    wanted_names, wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}: {got[:3]} vs {wanted[:3]}"
    for a, b in zip(got, wanted):
        if a != b or [type(x) is bool for x in a] != [type(x) is bool for x in b]:
            return f"{a} != {b}"
    return None
