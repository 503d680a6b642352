"""Plans by size: whether a frame is small enough for the plain plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 32 << 20


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the optimizer's estimate, made from file sizes without a job, is at most ``limit``.

    Estimates err upward behind joins, so ask about a frame near its source.
    Only plans are chosen by it: both give the same rows.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit
