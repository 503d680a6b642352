"""Readers, scan restrictions, views and CSV export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from campanula.functions.dates import epoch_ms_to_date, to_date_lit

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """One table of a parquet root; ``name.parquet`` may be a file or a folder.

    A known schema saves the look into the files.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def scan(
    df: DataFrame,
    *,
    since: tuple[str, dt.date | str] | None = None,
    partition: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Restrict a feed by partition value and start date, then project.

    The compared columns stay bare, so partition values prune folders and the
    date reaches the parquet reader.
    """
    for name, value in (partition or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    if since is not None:
        name, first_day = since
        df = df.where(F.col(name) >= to_date_lit(first_day))
    return df.select(*columns) if columns else df


def define_view(df: DataFrame, name: str) -> DataFrame:
    """Register the frame as a temporary view and return the view's frame."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's checkpoint folder, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def export_csv(df: DataFrame, path: str, *, single_file: bool = False, order: Sequence[Column] = ()) -> None:
    """Overwrite the folder ``path`` with CSV and a header.

    By default every task writes its own part file, and ``order`` makes the
    parts' names follow the order of the rows.  ``single_file`` writes one
    part, as hand-over extracts want it: the rows are sorted by all tasks, and
    one task then writes the sorted ranges one after the other, with no more
    than one of them at hand.  An empty frame gives a file with the header.
    """
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("header", True).csv(path)


def links_for_day(offers: DataFrame, day: dt.date | str, *, link_ms: str = "link_ms", link: str = "link") -> DataFrame:
    """Offers whose link was made on ``day`` (UTC).

    Written as a range on the raw milliseconds so that it is pushed down.
    """
    start = to_epoch_ms(day)
    return offers.where(F.col(link_ms).between(start, start + 86_400_000 - 1) & F.col(link).isNotNull())


def to_epoch_ms(day: dt.date | str) -> int:
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    return (day - dt.date(1970, 1, 1)).days * 86_400_000


def with_dates_from_ms(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Add a date column for each ``new name -> epoch-ms column``."""
    extra: dict[str, Column] = {new: epoch_ms_to_date(old) for new, old in names.items()}
    return df.withColumns(extra)
