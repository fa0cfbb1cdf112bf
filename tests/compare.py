"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, float):
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    return v.item() if hasattr(v, "item") else v


def rows(frame) -> Counter:
    names = sorted(frame.columns)
    return Counter(tuple(plain(plain(v)) for v in r) for r in frame[names].itertuples(index=False))


def same(spark, query, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{FOLDER}/{file}')")
    got, want = query(spark, FOLDER).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
