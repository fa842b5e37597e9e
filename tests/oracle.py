"""Compares a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bags(df, sql: str, sf_dir: str) -> tuple[Counter, Counter]:
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(sf_dir).sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols, (sorted(names), cols)
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return ours, theirs
