"""Text and number column helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from campanula.functions.dates import ColumnOrName, as_col


def suffix(c: ColumnOrName, n: int = 2) -> Column:
    """Last ``n`` characters."""
    return F.right(as_col(c).cast("string"), F.lit(n))


def last_name(c: ColumnOrName) -> Column:
    """Part before the first comma; empty when there is no comma."""
    c = as_col(c)
    return F.when(F.instr(c, ",") > 0, F.substring_index(c, ",", 1)).when(c.isNotNull(), "")


def first_name(c: ColumnOrName) -> Column:
    """Part after the first comma; everything when there is no comma."""
    c = as_col(c)
    return F.substr(c, F.instr(c, ",") + 1)


def digits(c: ColumnOrName) -> Column:
    """The digits of a text as an integer; NULL when there are none."""
    return F.trim(F.regexp_replace(as_col(c), "[^0-9 ]", "")).try_cast("int")


def speed_mbps(c: ColumnOrName) -> Column:
    """Speed label to Mbps; ``1 Giga`` counts as 1000."""
    c = as_col(c)
    return digits(F.when(c == "1 Giga", "1000 Megas").otherwise(c))


def matches(c: ColumnOrName, pattern: str) -> Column:
    """Whether the lowered text contains a match of ``pattern``."""
    return F.lower(as_col(c)).rlike(pattern)


def like_any(c: ColumnOrName, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).like(p) for p in patterns])


def like_none(c: ColumnOrName, patterns: Sequence[str]) -> Column:
    """NULL passes; a text passes when it fits none of the patterns."""
    c = as_col(c)
    return c.isNull() | ~like_any(c, patterns)


def two_digits(c: ColumnOrName) -> Column:
    return F.lpad(as_col(c).cast("string"), 2, "0")
