"""Spark's result against DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def norm(x: object) -> object:
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    if isinstance(x, int):
        return float(x)
    return str(x)


def from_duckdb(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {p.name.partition('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def from_spark(df) -> tuple[list[str], Counter]:  # noqa: ANN001
    names = sorted(df.columns)
    return names, Counter(tuple(map(norm, r)) for r in df.select(*names).collect())
