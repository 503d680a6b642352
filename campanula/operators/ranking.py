"""Ranking, capacity, gaps and per-partition counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campanula.operators.sizing import SMALL_BYTES, is_small


def rank_within(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` for partitions that are small by nature (one account, one interaction)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


PIECE_ROWS = 1_000_000  # rows that are numbered together
RANGES = 1024  # measured split points


def _directed(c: str, descending: bool) -> Column:
    return F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()


def with_piece(
    df: DataFrame, key: str, piece_rows: int = PIECE_ROWS, measured: DataFrame | None = None, name: str = "_piece"
) -> DataFrame:
    """Add ordered pieces of about ``piece_rows`` rows by a numeric key; NULL has none.

    Measured split points (``RANGES`` approximate quantiles) and the number of
    rows join the plan as one value of a subquery, worked out when the query
    runs and the same for every task.  Each range is cut evenly into as many
    pieces as the number of rows asks for, or ranges are taken together if it
    asks for fewer.  The cuts affect balance, never results, so they may be
    ``measured`` in a cheaper frame that holds about the same keys.
    """
    points = F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)
    facts = (df if measured is None else measured).select(F.struct(F.count(F.lit(1)).alias("n"), points.alias("cuts"), F.min(key).alias("least"), F.max(key).alias("most")))
    k, n, cuts = F.col(key), F.col("_facts.n"), F.col("_facts.cuts")
    wanted = F.greatest(F.ceil(n / piece_rows), F.lit(1))
    range_no = F.size(F.filter(cuts, lambda q: q < k))
    within = F.ceil(wanted / RANGES)  # pieces of a range
    low = F.when(range_no == 0, F.col("_facts.least")).otherwise(F.get(cuts, range_no - 1))
    high = F.coalesce(F.get(cuts, range_no), F.col("_facts.most"))
    part = F.least(F.floor(F.coalesce(F.try_divide((k - low) * within, high - low), F.lit(0))), within - 1)
    fine = range_no * within + F.greatest(part, F.lit(0))
    coarse = F.floor(range_no * wanted / RANGES)
    piece = F.when(wanted >= RANGES, fine).otherwise(coarse).cast("bigint")
    return df.withColumn("_facts", facts.scalar()).withColumn(name, F.when(k.isNotNull(), piece)).drop("_facts")


def _running(counts: DataFrame, by: Sequence[str], order: Sequence[Column]) -> Column:
    return F.sum("_n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")


def same_values(df: DataFrame, other: DataFrame, names: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names])


def rank_large(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[tuple[str, bool]],
    tiebreak: str,
    name: str,
    piece_rows: int = PIECE_ROWS,
    measured: DataFrame | None = None,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """``row_number`` over partitions too large for one task.

    ``order`` is a list of ``(column, descending)`` with few distinct value
    combinations (NULL last); ``tiebreak`` is a unique numeric column, ascending.
    Rows are counted per (partition, order values, piece of the tiebreak), and
    prefix sums run in two levels: over the order values of a partition, and
    over the pieces of one combination of values.  Their sum is the rank at
    which a piece starts; only the rows inside one piece are numbered together.
    Nothing is fetched and no job runs before the result is asked for.  The
    plan reads ``df`` for the counts and for the rows, and for the split points
    unless ``measured`` names another frame with the tiebreak column.  Where
    that frame has at most ``small_bytes``, one window does.
    """
    if is_small(df if measured is None else measured, small_bytes):
        whole = Window.partitionBy(*partition).orderBy(*[_directed(c, d) for c, d in order], F.col(tiebreak).asc())
        return df.withColumn(name, F.row_number().over(whole))
    df = with_piece(df, tiebreak, piece_rows, measured)
    names = [c for c, _ in order]
    values, cells = [*partition, *names], [*partition, *names, "_piece"]
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counts.withColumn("_inner", _running(counts, values, [F.col("_piece")]))
    totals = counts.groupBy(*values).agg(F.sum("_n").alias("_n"))
    outer = totals.withColumn("_outer", _running(totals, partition, [_directed(c, d) for c, d in order]))
    outer = outer.select(*[F.col(c).alias(f"_o_{c}") for c in values], "_outer")
    side = pieces.join(outer, same_values(pieces, outer, values, "_o_"))
    side = side.select(*[F.col(c).alias(f"_s_{c}") for c in cells], (F.col("_inner") + F.col("_outer")).alias("_start"))
    inside = Window.partitionBy(*cells).orderBy(F.col(tiebreak).asc())
    numbered = df.withColumn("_local", F.row_number().over(inside))
    joined = numbered.join(side, same_values(numbered, side, cells, "_s_"))
    return joined.withColumn(name, (F.col("_start") + F.col("_local")).cast("int")).drop(
        "_piece", "_local", "_start", *[f"_s_{c}" for c in cells]
    )


def top_capacity(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[tuple[str, bool]],
    capacity: int,
    share: float = 1.0,
    name: str = "position",
    exact: int = 0,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The best ``capacity * share`` rows of each group, with their position.

    ``order`` is a list of ``(column, descending)``, NULL last, that ends in
    something unique.  Its first ``exact`` columns have few values, the next
    one is a number.  Rows are counted per group, those values and pieces of
    that number, which Spark combines before the shuffle.  The running count
    tells where the places run out; rows behind that piece are dropped before
    anything is sorted.  What is left, the places and the rest of one piece, is
    ranked.  No group is read whole, whatever the capacity.
    """
    places = int(capacity * share + 1e-9)
    bins = [c for c, _ in order[:exact]]
    lead, descending = order[exact]
    binned = with_piece(df, lead, piece_rows)
    binned = binned.withColumn("_piece", -F.col("_piece")) if descending else binned
    cells = [*group, *bins, "_piece"]
    counts = binned.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    start = _running(counts, group, [*[_directed(c, d) for c, d in order[:exact]], F.col("_piece").asc_nulls_last()])
    wanted = counts.withColumn("_start", start).where(F.col("_start") < places)
    wanted = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in cells])
    finalists = binned.join(wanted, same_values(binned, wanted, cells, "_w_")).select(*df.columns)
    whole = Window.partitionBy(*group).orderBy(*[_directed(c, d) for c, d in order])
    return finalists.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= places)


def gaps(df: DataFrame, keys: Sequence[str], date_col: str, min_days: int = 1) -> DataFrame:
    """Days on which a key came back after being away for more than ``min_days``.

    Works on distinct days, so a key costs at most one row per calendar day.
    """
    days = df.select(*keys, date_col).distinct()
    w = Window.partitionBy(*keys).orderBy(date_col)
    seen = days.withColumn("previous", F.lag(date_col).over(w))
    return seen.withColumn("gap_days", F.date_diff(F.col(date_col), F.col("previous"))).where(F.col("gap_days") > min_days)


def distinct_per_partition(df: DataFrame, partition: str, key: str, name: str) -> DataFrame:
    """One row per partition value (NULL included) with its distinct keys."""
    return df.groupBy(partition).agg(F.count_distinct(key).alias(name))
