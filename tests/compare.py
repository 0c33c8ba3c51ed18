"""Spark-vs-DuckDB comparison in the shape the driver uses: row count,
column names, and an order-insensitive multiset of normalised rows."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("d", v.normalize() if v != 0 else decimal.Decimal(0))
    if isinstance(v, float):
        return ("f", float(f"{v:.9g}"))
    if isinstance(v, int):
        return ("d", decimal.Decimal(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = rel.fetchall()
    return [names[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    problems = []
    if sc != dc:
        problems.append(f"columns {sc} != {dc}")
    if sum(sr.values()) != sum(dr.values()):
        problems.append(f"rows {sum(sr.values())} != {sum(dr.values())}")
    if not problems and sr != dr:
        only_s = list((sr - dr).elements())[:3]
        only_d = list((dr - sr).elements())[:3]
        problems.append(f"values differ: spark-only {only_s} duck-only {only_d}")
    return problems
