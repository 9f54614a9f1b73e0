"""Holds a query's rows against its SQL in DuckDB, whole and with repeats."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(row[k]) for k in order) for row in rows)


def differences(spark, query, sql: str, where: str) -> list[str]:
    """What differs; empty if all is equal."""
    told = query(spark, where)
    with duckdb.connect() as db:
        for path in sorted(Path(where).glob("*.parquet")):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        asked = db.execute(sql)
        columns, rows = [c[0] for c in asked.description], asked.fetchall()
    if sorted(told.columns) != sorted(columns):
        return [f"columns {sorted(told.columns)} and {sorted(columns)}"]
    got, want = _bag(told.columns, map(tuple, told.collect())), _bag(columns, rows)
    return [f"only in Spark: {x}" for x in list((got - want))[:3]] + [f"only in SQL: {x}" for x in list((want - got))[:3]]
