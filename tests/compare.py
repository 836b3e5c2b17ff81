"""Run a registered query and its SQL over the same tables and compare every value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    return v


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short account of the first differences."""
    names, ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    onames, theirs = rows_of(cols, cur.fetchall())
    if names != onames:
        return f"columns {names} != {onames}"
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:3]
        missing = [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows != {len(theirs)}; only ours {extra}; only theirs {missing}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"\n  ours   {a}\n  theirs {b}\n  cols {names}"
    for i, n in enumerate(names):
        ka = {_kind(r[i]) for r in ours if r[i] is not None}
        kb = {_kind(r[i]) for r in theirs if r[i] is not None}
        if ka != kb:
            return f"column {n}: type {ka} != {kb}"
    return None
