"""Join operators.

Two habits keep these safe on skewed keys.  Facts are reduced to one row per
key (or per key and day) before they meet another table, which Spark does
partly ahead of the shuffle.  Where rows must meet a table on a key with few
values, :func:`split_join` deals the rows of heavy keys over several places.
And no side is broadcast by hint, except the list of heavy keys, which cannot
be longer than ``SHARE``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campanula.functions.dates import days_between
from campanula.operators.sizing import SMALL_BYTES, is_small

SHARE = 8192  # a key with more than this part of all rows is heavy, so there are fewer heavy keys than this
HOT_ROWS = 100_000  # rows that any one place may hold, however few rows there are in all


def join_left(base: DataFrame, dims: Sequence[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Left join each ``(frame, key)`` in turn; every frame has unique keys."""
    return reduce(lambda df, dim: df.join(dim[0], dim[1], "left"), dims, base)


def key_weights(df: DataFrame, keys: Sequence[str], *, nulls: bool = False) -> DataFrame:
    """Rows per key value, as columns ``_key0``, ... and ``_rows``, combined before the shuffle."""
    rows = df if nulls else df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_rows"))


def _drawn(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns a row's place is drawn from: ids, numbers and days besides the keys if there are any, as these are cheap to hash."""
    kinds = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "double", "decimal")
    plain = [name for name, kind in df.dtypes if name not in keys and kind.startswith(kinds)]
    return plain or df.columns


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    columns: Mapping[str, str],
    *,
    how: str = "left",
    residual: Column | None = None,
    null_safe: bool = False,
    unique: bool = False,
    weights: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Equi join whose heavy keys are split over as many places as their weight asks for.

    ``on`` maps key columns of ``left`` to those of ``right``; ``columns`` maps
    new names to columns of ``right``.  A key weighs its rows in ``left``; a
    place holds a ``SHARE``-th of all rows, or ``hot_rows`` if that is more.
    Rows of a heavier key are dealt over several places, and the rows of
    ``right`` with that key are repeated for each.  Rows whose key is NULL meet
    nobody and are kept apart, over ``SHARE`` places, unless ``null_safe``
    makes NULL a key like any other.  ``weights`` (see :func:`key_weights`) may
    come from a cheaper table: they decide balance, never the result.  The
    list of heavy keys is sent to every executor; it has fewer than ``SHARE``
    rows, since each stands for more than that part of the total.  Where the
    table the weights come from has at most ``small_bytes``, no key can be
    heavy and the plain join is planned.

    ``unique`` says that ``right`` has a row per key, for left joins without
    ``residual``.  The rows of ``right`` with heavy keys are then sent along
    with the list, and only the other keys are met by shuffle; as that side
    waits for no weights, adaptive execution knows its size before the rows
    of ``left`` move, and moves none where it is small.
    """
    if unique and (how != "left" or residual is not None):
        raise ValueError("unique is for left joins without a residual")
    names = list(on)
    if weights is None:
        weights = key_weights(left, names, nulls=null_safe)
    side = right.select(
        *[F.col(c).alias(f"_right{i}") for i, c in enumerate(on.values())], *[F.col(c).alias(n) for n, c in columns.items()]
    )

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if null_safe else a == b

    meet = reduce(lambda a, b: a & b, [same(F.col(k), F.col(f"_right{i}")) for i, k in enumerate(names)])
    if residual is not None:
        meet = meet & residual
    if is_small(weights, small_bytes):
        return left.join(side, meet, how).select(*left.columns, *columns)

    unit = F.greatest(weights.select(F.sum("_rows")).scalar() / SHARE, F.lit(hot_rows))
    heavy = weights.where(F.col("_rows") > unit)
    if unique:
        return _met_once(left, side, names, list(columns), heavy.drop("_rows"), meet, null_safe)
    heavy = heavy.withColumn("_places", F.ceil(F.col("_rows") / unit).cast("int")).drop("_rows")

    def matches(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [same(df[k], other[f"_key{i}"]) for i, k in enumerate(keys)])

    draw = F.xxhash64(*[F.col(c) for c in _drawn(left, names)])
    salt = F.when(F.col("_places").isNotNull(), F.pmod(draw, F.col("_places")))
    if not null_safe:
        unknown = reduce(lambda a, b: a | b, [left[k].isNull() for k in names])
        salt = F.when(unknown, F.pmod(draw, F.lit(SHARE))).otherwise(salt)
    spread = left.join(F.broadcast(heavy), matches(left, heavy, names), "left")
    spread = spread.select(*[left[c] for c in left.columns], F.coalesce(salt, F.lit(0)).cast("int").alias("_salt"))

    side = side.join(F.broadcast(heavy), matches(side, heavy, [f"_right{i}" for i in range(len(on))]), "left")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_places"), F.lit(1)) - 1))
    side = side.withColumn("_right_salt", copies).drop("_places", *[f"_key{i}" for i in range(len(on))])
    joined = spread.join(side, meet & (F.col("_salt") == F.col("_right_salt")), how)
    return joined.select(*left.columns, *columns)


def _met_once(
    left: DataFrame, side: DataFrame, names: Sequence[str], columns: Sequence[str], heavy: DataFrame, meet: Column, null_safe: bool
) -> DataFrame:
    """Rows of heavy keys meet ``side`` by broadcast, others by shuffle; the former and those without key lie anywhere."""
    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if null_safe else a == b

    keys = [f"_key{i}" for i in range(len(names))]
    found = reduce(lambda a, b: a & b, [same(heavy[k], side[f"_right{i}"]) for i, k in enumerate(keys)])
    values = [side[c].alias(f"_hot{i}") for i, c in enumerate(columns)]
    hot = heavy.join(side, found, "left").select(*[heavy[k] for k in keys], *values, F.lit(True).alias("_hot"))
    known = reduce(lambda a, b: a & b, [same(left[n], hot[k]) for n, k in zip(names, keys, strict=True)])
    apart = reduce(lambda a, b: a | b, [left[n].isNull() for n in names])
    draw = F.pmod(F.xxhash64(*[left[c] for c in _drawn(left, names)]), F.lit(SHARE)) + 1
    # heavy keys have met already, and NULL meets nobody
    salt = F.when(hot["_hot"] if null_safe else hot["_hot"] | apart, draw).otherwise(0)
    spread = left.join(F.broadcast(hot), known, "left").select(
        *[left[c] for c in left.columns], hot["_hot"], *[hot[f"_hot{i}"] for i in range(len(columns))], salt.cast("int").alias("_salt")
    )
    # 0 for all, but not a literal: the place has to stay a key of the join
    side = side.withColumn("_right_salt", F.pmod(F.hash("_right0"), F.lit(1)))
    joined = spread.join(side, meet & (F.col("_salt") == F.col("_right_salt")), "left")
    picked = [F.when(F.col("_hot"), F.col(f"_hot{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)]
    return joined.select(*left.columns, *picked)


def role_join(
    df: DataFrame,
    dim: DataFrame,
    dim_key: str,
    roles: Mapping[str, str],
    weights: Mapping[str, DataFrame] | None = None,
    **sizes: int,
) -> DataFrame:
    """Join one dimension once per role, heavy and NULL keys split by weight.

    ``roles`` maps a column prefix to the key column of ``df``; the columns of
    the dimension arrive as ``<prefix>_<column>``.  ``weights`` may hold the
    weights of some roles; the others are counted in ``df`` as it is given,
    together.  ``dim`` has one row per key.  ``sizes`` are those of :func:`split_join`.
    """
    counted = {prefix: key for prefix, key in roles.items() if prefix not in (weights or {})}
    weighed = _role_weights(df, counted) | dict(weights or {})
    for prefix, key in roles.items():
        columns = {f"{prefix}_{c}": c for c in dim.columns if c != dim_key}
        df = split_join(df, dim, {key: dim_key}, columns, unique=True, weights=weighed[prefix], **sizes)
    return df


def _role_weights(df: DataFrame, roles: Mapping[str, str]) -> dict[str, DataFrame]:
    """:func:`key_weights` of every role, whose key columns come from one reading of ``df``."""
    if len({df.schema[key].dataType for key in roles.values()}) != 1:
        return {prefix: key_weights(df, [key]) for prefix, key in roles.items()}
    pairs = F.array(*[F.struct(F.lit(prefix).alias("_role"), F.col(key).alias("_key")) for prefix, key in roles.items()])
    rows = key_weights(df.select(F.explode(pairs).alias("_p")).select("_p.*").where("_key IS NOT NULL"), ["_role", "_key"])
    return {prefix: rows.where(F.col("_key0") == prefix).select(F.col("_key1").alias("_key0"), "_rows") for prefix in roles}


def key_set(df: DataFrame, on: str | list[str]) -> DataFrame:
    """Distinct keys.  Repeats go before the shuffle the join needs anyway."""
    return df.select(*([on] if isinstance(on, str) else on)).distinct()


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Keep the keys that ``keys`` holds."""
    return df.join(key_set(keys, on), on, "left_semi")


def anti(df: DataFrame, *suppress: DataFrame, on: str | list[str]) -> DataFrame:
    """Remove every key that any of the ``suppress`` frames holds."""
    return reduce(lambda acc, s: acc.join(key_set(s, on), on, "left_anti"), suppress, df)


def intersect_ids(*frames: DataFrame, on: str) -> DataFrame:
    """Distinct keys present in all frames."""
    first, *rest = frames
    return reduce(lambda acc, f: semi(acc, f, on), rest, key_set(first, on))


def lookup(df: DataFrame, dim: DataFrame, key: str, *, weight: str | None = None, **sizes: int) -> DataFrame:
    """Left join to a frame with one row per key when some keys are hot.

    NULL is a key like any other.  ``weight`` is a column of ``dim`` that holds
    the number of rows of ``df`` per key; it is counted when not given.
    """
    known = None if weight is None else dim.select(F.col(key).alias("_key0"), F.col(weight).alias("_rows"))
    columns = {c: c for c in dim.columns if c != key}
    return split_join(df, dim, {key: key}, columns, null_safe=True, unique=True, weights=known, **sizes)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_date: str,
    right_date: str,
    min_days: int,
    max_days: int,
) -> DataFrame:
    """All pairs of one key with ``min_days <= right - left <= max_days``.

    The time line is cut into spans as long as the interval; a left row looks
    into the two spans it can reach.  Rows of one busy key are thus spread
    over the time line instead of meeting in one place.
    """
    width = max_days - min_days + 1
    epoch = F.lit("1970-01-01").cast("date")

    def span(day: Column) -> Column:
        return F.floor(F.date_diff(day, epoch) / width)

    start = span(F.date_add(F.col(left_date), min_days))
    reach = left.withColumn("_span", F.explode(F.array(start, start + 1)))
    spans = right.withColumn("_span", span(F.col(right_date)))
    pairs = reach.join(spans, [on, "_span"])
    return pairs.where(days_between(left_date, right_date).between(min_days, max_days)).drop("_span")


def nearest_in_window(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_date: str,
    right_date: str,
    min_days: int | None,
    max_days: int,
    name: str,
) -> DataFrame:
    """Per key and left day, the latest right day inside the interval.

    Returns distinct ``(on, left_date, name)`` where there is one.  Both sides
    are reduced to distinct days first and merged in date order, so a key costs
    at most two rows per calendar day however many rows it has, and no pairs
    are formed.  ``min_days`` None looks back without limit.
    """
    on = [on] if isinstance(on, str) else list(on)
    queries = left.select(*on, F.col(left_date).alias("_left")).distinct().select(
        *on, "_left", F.lit(None).cast("date").alias("_right"), F.date_add("_left", max_days).alias("_at"), F.lit(1).alias("_kind")
    )
    marks = right.select(*on, F.col(right_date).alias("_right")).distinct().select(
        *on, F.lit(None).cast("date").alias("_left"), "_right", F.col("_right").alias("_at"), F.lit(0).alias("_kind")
    )
    w = Window.partitionBy(*on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = queries.unionByName(marks).withColumn(name, F.last("_right", ignorenulls=True).over(w))
    found = F.col(name).isNotNull() if min_days is None else days_between("_left", name) >= min_days
    return seen.where((F.col("_kind") == 1) & found).select(*on, F.col("_left").alias(left_date), name)


def asof_backward(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, name: str) -> DataFrame:
    """Per key and left day, the latest right day on or before it, however long ago."""
    return nearest_in_window(left, right, on, left_date, right_date, None, 0, name)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_date: str,
    right_date: str,
    name: str,
) -> DataFrame:
    """First right day on or after the left day, for a left side with unique keys."""
    on = list(on)
    later = right.join(left.select(*on, left_date), on).where(F.col(right_date) >= F.col(left_date))
    return later.groupBy(*on, left_date).agg(F.min(right_date).alias(name))


def any_key_lookup(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], dim_key: str, value: str, name: str, **sizes: int
) -> DataFrame:
    """Left join on ``k1 = key OR k2 = key OR ...`` to a frame with unique keys.

    One lookup per key column instead of a nested-loop join; the distinct
    dimension rows found become output rows, and a row without any keeps one
    row with NULL.
    """
    roles = {f"_m{i}": k for i, k in enumerate(keys)}
    side = dim.select(F.col(dim_key), F.struct(F.col(dim_key), F.col(value)).alias("hit"))
    found = role_join(df, side, dim_key, roles, **sizes)
    hits = F.array_distinct(F.array_compact(F.array(*[F.col(f"{p}_hit") for p in roles])))
    return found.select(*[F.col(c) for c in df.columns], F.explode_outer(hits).alias("_hit")).select(
        *[F.col(c) for c in df.columns], F.col("_hit")[value].alias(name)
    )


def theta_join(
    left: DataFrame, right: DataFrame, on: Mapping[str, str], columns: Mapping[str, str], residual: Column, how: str = "left", **sizes: int
) -> DataFrame:
    """Equi join with a further condition kept inside the join, heavy keys split by weight."""
    return split_join(left, right, on, columns, how=how, residual=residual, **sizes)


def successor(
    queries: DataFrame, entries: DataFrame, on: Sequence[str], at: str, value: str, *, strict: bool = True, width: float | None = None
) -> DataFrame:
    """``queries`` with ``value`` of the first entry of their group behind ``at`` (or on it, unless ``strict``).

    Both sides hold ``on``, ``at`` and entries also ``value``; of entries at
    one place the least value counts.  Queries without such an entry go.  The
    two are merged in descending order of ``at``, so the cost is that of a sort
    and no list or pair is formed.  With ``width`` a group is cut into spans of
    that length, each sorted on its own: the first entry behind a span, found
    by the same merge over span ends, stands for all that follow.
    """
    on = list(on)
    if width is None:
        first, then = (0, 1) if strict else (1, 0)
        blank = F.lit(None).cast(entries.schema[value].dataType)
        both = queries.withColumn(value, blank).withColumn("_kind", F.lit(first)).unionByName(
            entries.select(*on, at, value).withColumn("_kind", F.lit(then)), allowMissingColumns=True
        )
        order = [F.col(at).desc(), F.col("_kind").asc(), F.col(value).desc_nulls_first()]
        w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = both.withColumn(value, F.last(value, ignorenulls=True).over(w))
        return seen.where((F.col("_kind") == first) & F.col(value).isNotNull()).drop("_kind")
    span = F.floor(F.col(at) / width)
    cut = queries.withColumn("_span", span)
    ends = cut.select(*on, "_span").distinct().withColumn(at, ((F.col("_span") + 1) * width).cast(entries.schema[at].dataType))
    carried = successor(ends, entries, on, at, value, strict=False)
    inside = entries.select(*on, at, value).withColumn("_span", span).unionByName(carried)
    return successor(cut, inside, [*on, "_span"], at, value, strict=strict).drop("_span")
