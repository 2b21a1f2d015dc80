"""Run a query in Spark and its SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(repr(value)) + 0.0
    return value


def rows_sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def compare(df, con, sql):
    """Empty text when equal, else a short description of the difference."""
    left = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    right = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    allowed = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}
    for name, kind in df.dtypes:
        if allowed.get(kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = rows_sorted(df.columns, left), rows_sorted(names, right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""
