"""Decision columns: buckets, lookups and ordered rule tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from campanula.functions.dates import ColumnOrName, as_col


def bucket(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that holds; ``default`` (or NULL) if none does."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(default)


def value_map(c: ColumnOrName, mapping: Mapping[object, object], default: object = None) -> Column:
    """Look a value up in a fixed mapping; unknown values give ``default``."""
    c = as_col(c)
    return bucket([(c == F.lit(k), v) for k, v in mapping.items()], default)


def is_x(c: ColumnOrName) -> Column:
    """True for ``'X'``; everything else, NULL included, is false."""
    return as_col(c).eqNullSafe(F.lit("X"))


def neq_or_null(c: ColumnOrName, value: object) -> Column:
    c = as_col(c)
    return (c != F.lit(value)) | c.isNull()


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 otherwise (also when it is unknown)."""
    return F.when(condition, 1).otherwise(0)


def true_if(condition: Column) -> Column:
    """Boolean form of :func:`flag`."""
    return F.coalesce(condition, F.lit(False))
