"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def count_distinct(df: DataFrame, by: Mapping[str, Column] | Sequence[str], key: str | Column, name: str) -> DataFrame:
    """Distinct keys per group; with an empty ``by``, over the whole frame.

    Rows are reduced to distinct (group, key) before groups are counted, so a
    group that holds most rows is still counted by many tasks.
    """
    cols = [c.alias(n) for n, c in by.items()] if isinstance(by, Mapping) else [F.col(c) for c in by]
    counted = F.count_distinct(key).alias(name)
    return df.groupBy(*cols).agg(counted) if cols else df.agg(counted)


def conditional_max(df: DataFrame, by: Sequence[str], columns: Mapping[str, tuple[Column | None, str | Column]]) -> DataFrame:
    """One pass of maxima per group, each over the rows its condition keeps."""
    def one(name: str, condition: Column | None, value: str | Column) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.max(value if condition is None else F.when(condition, value)).alias(name)

    return df.groupBy(*by).agg(*[one(n, c, v) for n, (c, v) in columns.items()])


def half_up(num: Column, den: Column, decimals: int = 2) -> Column:
    """Quotient of two counts, rounded half up in whole numbers; NULL over zero."""
    scale = 10**decimals
    steps = F.call_function("div", 2 * scale * num + den, 2 * den)
    return F.when(den > 0, steps / F.lit(float(scale)))


def ratio(df: DataFrame, by: Sequence[str], num: Column, den: Column, name: str, decimals: int = 2) -> DataFrame:
    """Rows fulfilling ``num`` over rows fulfilling ``den``, rounded half up; NULL without any."""
    return df.groupBy(*by).agg(half_up(F.count_if(num), F.count_if(den), decimals).alias(name))


def multiset(df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Each group's distinct values with how often they stand there, as ``n``.

    The form to keep and to search texts of a group in: a group that holds most
    rows stays one row per distinct value, and no list is built.
    """
    return df.where(value.isNotNull()).groupBy(*by, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def fold_strings(df: DataFrame, by: Sequence[str], c: str, name: str, *, lower: bool = True) -> DataFrame:
    """All texts of a group as one list in order, lowered unless told otherwise, with their number as ``entries``.

    Repeats are counted first, as in :func:`multiset`, and joined as (text, count)
    pairs: a group brings together one entry per distinct text, and repeats are
    written out in the result only, by repeating the text itself.
    """
    counted = df.groupBy(*by, F.col(c).alias("_text")).agg(F.count(c).alias("n"))
    pair = F.when(F.col("_text").isNotNull(), F.struct("_text", "n"))
    pairs = counted.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("_all"), F.sum("n").alias("entries"))
    written = F.transform("_all", lambda p: F.concat(p["_text"], F.repeat(F.concat(F.lit(","), p["_text"]), (p["n"] - 1).cast("int"))))
    text = F.array_join(written, ",")
    return pairs.select(*by, (F.lower(text) if lower else text).alias(name), "entries")
