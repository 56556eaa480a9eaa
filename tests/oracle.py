"""Run a registered query and its SQL side by side and describe any difference."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    mine = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order_a = [df.columns.index(c) for c in sorted(df.columns)]
    order_b = [names.index(c) for c in sorted(names)]
    a = sorted((tuple(_plain(r[i]) for i in order_a) for r in mine), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in order_b) for r in theirs), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}: {a[:2]} / {b[:2]}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    if differing:
        return f"{len(differing)} of {len(a)} rows differ: {differing[:2]}"
    kinds = [(c, {type(r[i]).__name__ for r in a}, {type(r[i]).__name__ for r in b}) for i, c in enumerate(sorted(names))]
    odd = [k for k in kinds if k[1] != k[2]]
    return f"types {odd}" if odd else None
