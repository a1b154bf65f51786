"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else int(f) if f.is_integer() else float(f"{f:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    cur = con.execute(sql)
    return bag([d[0] for d in cur.description], cur.fetchall())
