"""Compares a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def differences(df, sql: str, sf_dir: str, limit: int = 3) -> list:
    """What differs: columns, or rows on one side alone."""
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = duck(sf_dir).sql(sql)
    if sorted(rel.columns) != names:
        return [("columns", names, sorted(rel.columns))]
    place = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[p]) for p in place) for r in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return [("rows", len(ours), len(theirs))]
    return [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b][:limit]
