"""Compares a query with its SQL as value hashes would: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and (math.isnan(v) or v == 0):
        return "nan" if math.isnan(v) else 0.0
    return str(v) if isinstance(v, (list, dict, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql: str, sf_dir: str = SF) -> str:
    """An empty string, or what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    expected = rows_of(columns, want.fetchall())
    df = query(spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected[0] != found[0]:
        return f"columns {found[0]}, SQL has {expected[0]}"
    more, less = found[1] - expected[1], expected[1] - found[1]
    return f"{sum(more.values())} rows of {sum(found[1].values())} differ: {list(more)[:3]} against {list(less)[:3]}" if more or less else ""
