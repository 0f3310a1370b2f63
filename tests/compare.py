"""Compares a query with its SQL twin, order-insensitively."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path = f"{path}/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, dict):
        v = tuple(v.values()) if not all(isinstance(k, str) for k in v) else tuple(v.values())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both agree; else what differs first."""
    a_names, a = rows(df.columns, df.collect())
    rel = con.execute(sql)
    b_names, b = rows([d[0] for d in rel.description], rel.fetchall())
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}: {a[:1]} {b[:1]}"
    for x, y in zip(a, b, strict=True):
        if x != y or [type(p) for p in x] != [type(q) for q in y]:
            return f"{x} and {y}"
    return ""
