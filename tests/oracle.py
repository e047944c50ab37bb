"""Spark rows against DuckDB rows of the same query."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return sorted(names), sorted(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in result.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(row[n]) for n in names) for row in df.collect())
