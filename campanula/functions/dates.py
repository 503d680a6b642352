"""Date and epoch column helpers.

None of them reads the clock or the session time zone: the day everything is
measured from is always an argument.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_date_lit(day: dt.date | str) -> Column:
    """A date literal; folded at planning time, so it can be pushed down."""
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    return F.lit(day)


def epoch_ms_to_date(ms: ColumnOrName) -> Column:
    """UTC day of an epoch-millisecond value."""
    return F.date_add(F.lit(EPOCH), F.floor(as_col(ms) / DAY_MS).cast("int"))


def date_to_epoch_ms(day: ColumnOrName) -> Column:
    return F.date_diff(as_col(day), F.lit(EPOCH)).cast("bigint") * F.lit(DAY_MS)


def date_to_epoch_seconds(day: ColumnOrName) -> Column:
    return F.date_diff(as_col(day), F.lit(EPOCH)).cast("bigint") * F.lit(86_400)


def parse_date(c: ColumnOrName, fmt: str) -> Column:
    """Date of a text in ``fmt``; NULL when it does not fit."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("date")


def parse_yyyymmdd(c: ColumnOrName) -> Column:
    """Date from the first eight digits of a number or text."""
    return parse_date(F.substring(as_col(c).cast("string"), 1, 8), "yyyyMMdd")


def parse_clock_text(c: ColumnOrName) -> Column:
    """Timestamp of ``31/01/2024 08:05:00 a.m.`` style text."""
    return F.try_to_timestamp(F.upper(F.replace(as_col(c), F.lit("."), F.lit(""))), F.lit("d/M/yyyy h:m:s a"))


def month_start(day: ColumnOrName) -> Column:
    """First day of the month, as a date."""
    return F.trunc(as_col(day), "MM")


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Days from ``start`` to ``end``; negative when ``end`` is earlier."""
    return F.date_diff(as_col(end), as_col(start))


def within_days(start: ColumnOrName, end: ColumnOrName, low: int, high: int) -> Column:
    return days_between(start, end).between(low, high)


def complete_months(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole months passed from ``start`` to ``end``."""
    start, end = as_col(start), as_col(end)
    raw = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    # one month less while the day of the month has not come round yet; a
    # start day the end month does not have counts as reached on its last day
    short = (F.dayofmonth(end) < F.dayofmonth(start)) & (end != F.last_day(end))
    over = (F.dayofmonth(end) > F.dayofmonth(start)) & (start != F.last_day(start))
    return raw - F.when((raw > 0) & short, 1).when((raw < 0) & over, -1).otherwise(0)


def add_months_sticky(day: ColumnOrName, months: int) -> Column:
    """Add months; the last day of a month stays the last day of a month."""
    day = as_col(day)
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def shift_months(day: dt.date | str, months: int, *, sticky: bool = False) -> Column:
    base = to_date_lit(day)
    return add_months_sticky(base, months) if sticky else F.add_months(base, months)


def cycle_bill_date(as_of: dt.date | str, cycle_day: ColumnOrName) -> Column:
    """Most recent bill date for a monthly cycle day, as seen on ``as_of``.

    A cycle day past the end of a month bills on that month's last day.
    """
    today = to_date_lit(as_of)
    cycle = as_col(cycle_day)
    month = F.when(cycle > F.dayofmonth(today), F.add_months(F.trunc(today, "MM"), -1)).otherwise(F.trunc(today, "MM"))
    return F.date_add(month, F.least(cycle, F.dayofmonth(F.last_day(month))).cast("int") - 1)
