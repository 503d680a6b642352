"""Choosing snapshots, and the latest or first rows per key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campanula.functions.dates import to_date_lit


def latest_snapshot(df: DataFrame, as_of_col: str) -> DataFrame:
    """Rows of the newest snapshot of the whole table.

    The newest value is a scalar subquery over one column: it costs a single
    narrow aggregate, and its result filters the main scan at run time, where
    it prunes partitions if the table is partitioned by that column.
    """
    newest = df.select(F.max(as_of_col)).scalar()
    return df.where(F.col(as_of_col) == newest)


def snapshot_at(df: DataFrame, as_of_col: str, value: object) -> DataFrame:
    """Rows of one known snapshot: a day, an epoch-ms number, or another column."""
    if isinstance(value, dt.date):
        value = to_date_lit(value)
    return df.where(F.col(as_of_col) == value)


def first_of_month(df: DataFrame, date_col: str) -> DataFrame:
    """Snapshots taken on the first day of a month."""
    return df.where(F.dayofmonth(date_col) == 1)


def latest_ties(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """All rows that carry their key's greatest ``order_col``.

    The maxima are combined before the shuffle and joined back, so rows of a
    hot key are never gathered in one task.  Made for coarse keys such as a
    campaign, where the rows kept are a good part of the table.
    """
    keys = list(keys)
    newest = df.groupBy(*keys).agg(F.max(order_col).alias(order_col))
    return df.join(newest, [*keys, order_col], "left_semi")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    ``order`` must end in something unique for a repeatable result.  The rank
    filter lets Spark drop all but ``n`` rows per key in each task before the
    shuffle, which also takes the weight off hot keys.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_tied_rows(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """All rows that share their key's first place in the given order.

    The single-pass form of :func:`latest_ties` for fine keys such as an
    account, where ties are few; rows that cannot win are dropped before the
    shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Selected columns of the first row per key in the given order."""
    return latest_row(df, keys, order).select(*keys, *columns)


def first_event(df: DataFrame, keys: Sequence[str], time_cols: Sequence[str]) -> DataFrame:
    """Earliest time per key, for one or more time columns."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in time_cols])
