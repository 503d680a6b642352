"""Account-key helpers: reconcile numeric, text and prefixed ids once, at the source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from campanula.functions.dates import ColumnOrName, as_col


def normalize_key(c: ColumnOrName) -> Column:
    """Account id as a long; NULL when it is not a number."""
    return F.trim(as_col(c).cast("string")).try_cast("bigint")


def account_key(c: ColumnOrName, prefix_length: int = 8) -> Column:
    """Account number of a prefixed id."""
    return F.substr(as_col(c), F.lit(prefix_length + 1)).try_cast("bigint")


def prefixed_account(c: ColumnOrName, prefix: str) -> Column:
    return F.concat(F.lit(prefix), as_col(c).cast("string"))


def first_valid_id(candidates: Sequence[ColumnOrName], length: int = 12) -> Column:
    """First candidate that is a positive number of exactly ``length`` characters."""
    fields = F.array(*[as_col(c) for c in candidates])
    valid = F.filter(fields, lambda c: (F.length(c) == length) & (c.try_cast("bigint") > 0))
    return F.get(valid, F.lit(0))
