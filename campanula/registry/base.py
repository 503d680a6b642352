"""Registering queries together with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from campanula.sources.star import AS_OF, LOGICAL, logical_sql, logical_table
from campanula.sources.tables import TABLES, read_table

__all__ = ["AS_OF", "AS_OF_SQL", "QUERIES", "Tables", "day_of", "bundle_sql", "fragment", "oracle", "products_sql", "query", "x_sql"]

AS_OF_SQL = f"DATE '{AS_OF}'"


def day_of(ms: str) -> str:
    """SQL for the UTC day of an epoch-ms column."""
    return f"CAST(epoch_ms({ms}) AS DATE)"


class Tables:
    """Tables by attribute: physical ones as they are, logical ones derived."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._schemas: dict[str, StructType] = {}

    def read(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.root, name, self._schemas.get(name))
        self._schemas.setdefault(name, df.schema)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in LOGICAL:
            return logical_table(self.read, name)
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
# named SQL fragments that check several queries
FRAGMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, sql)
        return build

    return register


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def _body(name: str) -> str:
    return FRAGMENTS[name] if name in FRAGMENTS else logical_sql(name)


def oracle(sql: str) -> str:
    """Put the logical tables and fragments a statement uses in front of it."""
    known = [*LOGICAL, *FRAGMENTS]
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text, re.IGNORECASE):
                visit(_body(name))
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    tables = ", ".join(f"{n} AS ({_body(n)})" for n in order)
    rest = re.match(r"\s*WITH\s+(.*)", sql, re.IGNORECASE | re.DOTALL)
    return f"WITH {tables}, {rest.group(1)}" if rest else f"WITH {tables} {sql}"


def x_sql(c: str) -> str:
    return f"coalesce({c} = 'X', false)"


def bundle_sql(cable: str, internet: str, phone: str) -> str:
    """SQL for the one package code the three products agree on."""
    parts = [f"substring({c}, 1, 5)" for c in (cable, internet, phone)]
    named = ", ".join(f"nullif({p}, ' ')" for p in parts)
    unknown = " OR ".join(f"{p} IS NULL" for p in parts)
    absent = " AND ".join(f"{p} = ' '" for p in parts)
    return (
        f"CASE WHEN {unknown} THEN NULL WHEN {absent} THEN ' '"
        f" WHEN greatest({named}) = least({named}) THEN greatest({named}) END"
    )


def products_sql(code: str) -> str:
    """SQL for the number of products of a package code."""
    mask = f"coalesce(substring({code}, 2, 1), '0')"
    return f"(CASE WHEN {mask} IN ('1','2','4') THEN 1 WHEN {mask} IN ('3','5','6') THEN 2 WHEN {mask} = '7' THEN 3 ELSE 0 END)"
