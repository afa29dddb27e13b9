"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, float)):
            return float(x)
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()
