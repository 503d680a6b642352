"""Comparing a Spark result with the result of its SQL."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from campanula.sources.tables import TABLES

_SAME_TYPE = {"int64": "bigint", "varchar": "string", "integer": "int", "float64": "double"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _kind(t: str) -> str:
    t = t.lower()
    return _SAME_TYPE.get(t, t)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Number of rows, and what differs in columns, types or rows (None if nothing)."""
    cols = sorted(df.columns)
    left = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: _kind(str(d[1])) for d in cursor.description}
    if sorted(names) != cols:
        return len(left), f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = sorted((tuple(_norm(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if left != right:
        seen_left, seen_right = set(left), set(right)
        return len(left), (
            f"{len(left)} vs {len(right)} rows of {cols}; only Spark {[r for r in left if r not in seen_right][:3]};"
            f" only SQL {[r for r in right if r not in seen_left][:3]}"
        )
    wrong = [(c, t, types[c]) for c, t in df.dtypes if _kind(t) != types[c]]
    return len(left), f"types {wrong}" if wrong else None
