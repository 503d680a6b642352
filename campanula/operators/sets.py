"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_months(*frames: DataFrame) -> DataFrame:
    """Stack result tables by column name, keeping every row."""
    return reduce(lambda a, b: a.unionByName(b), frames)
