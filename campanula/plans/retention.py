"""Base, tenure, delinquency, contact and churn metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import complete_months, days_between, month_start, parse_yyyymmdd, to_date_lit
from campanula.functions.rules import bucket
from campanula.operators.grouping import count_distinct
from campanula.operators.joining import nearest_in_window
from campanula.operators.ranking import gaps
from campanula.operators.snapshot import first_of_month

KEY = "account_no"
ACTIVE_DAYS = 90


def in_year(day: str, year: int) -> Column:
    """A year as a date range, so that it is pushed down."""
    return F.col(day).between(to_date_lit(dt.date(year, 1, 1)), to_date_lit(dt.date(year, 12, 31)))


def active_base(df: DataFrame, year: int, *, residential: str = "Residencial", days: int = ACTIVE_DAYS) -> DataFrame:
    """Residential accounts less than ``days`` days overdue, in one year."""
    return df.where(
        in_year("dt", year) & (F.col("customer_type") == residential) & (F.col("outstanding_age") < days)
    )


def monthly_active_accounts(df: DataFrame, year: int | None = None, *, first_day_only: bool = False) -> DataFrame:
    """Accounts per month; on first days of months only when asked."""
    kept = df if year is None else df.where(in_year("dt", year))
    kept = first_of_month(kept, "dt") if first_day_only else kept
    return count_distinct(kept, {"year": F.year("dt"), "month": F.month("dt")}, KEY, "accounts")


def first_day_per_month(df: DataFrame, year: int) -> DataFrame:
    """Accounts per month with the first day of the month that has data."""
    kept = df.where(in_year("dt", year))
    return kept.groupBy(F.month("dt").alias("month")).agg(
        F.min(F.dayofmonth("dt")).alias("first_day"), F.count_distinct(KEY).alias("accounts")
    )


def orders_by_month(orders: DataFrame, year: int, account_type: str = "Residential") -> DataFrame:
    kept = orders.where(in_year("order_start", year) & (F.col("account_type") == account_type))
    return count_distinct(kept, {"month": F.month("order_start")}, "order_id", "orders")


def interactions_by_type(interactions: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    kept = interactions.where(F.col("start_date").between(to_date_lit(start), to_date_lit(end)))
    return count_distinct(kept, ["purpose"], "interaction_id", "interactions")


def tenure_class() -> Column:
    months = complete_months("start_date", "dt")
    return bucket([(months < 6, "early tenure"), (months <= 12, "mid tenure")], "late tenure")


def tenure_class_counts(df: DataFrame) -> DataFrame:
    """Accounts per day and tenure class on first days of months."""
    days = first_of_month(df, "dt")
    return count_distinct(days, {"dt": F.col("dt"), "tenure_class": tenure_class()}, KEY, "accounts")


def tenure_class_totals(df: DataFrame) -> DataFrame:
    """Class counts added up again per day, to compare with the plain count."""
    return tenure_class_counts(df).groupBy("dt").agg(F.sum("accounts").cast("bigint").alias("accounts"))


def delinquency_days(df: DataFrame) -> DataFrame:
    """Days since the oldest unpaid bill and the resulting activity class."""
    days = days_between(parse_yyyymmdd("oldest_unpaid"), "dt")
    return df.select(KEY, "dt", days.alias("days_overdue")).withColumn("activity", activity_class("days_overdue"))


def activity_class(days: str) -> Column:
    """Inactive from 90 days on; nothing unpaid means active."""
    return bucket([(F.col(days) >= ACTIVE_DAYS, "Inactivos")], "Activos")


def active_inactive_counts(df: DataFrame) -> DataFrame:
    return count_distinct(delinquency_days(df), ["activity"], KEY, "accounts")


def active_then_deactivated(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Active accounts per month with a deactivation order in the same month.

    Both sides shrink to distinct account and month before they meet.
    """
    active = (
        delinquency_days(df).where(F.col("activity") == "Activos").select(KEY, month_start("dt").alias("month")).distinct()
    )
    left = orders.where(F.col("order_type") == "DEACTIVATION").select(KEY, month_start("order_start").alias("month")).distinct()
    return active.join(left, [KEY, "month"], "left_semi").groupBy("month").agg(F.count(KEY).alias("accounts"))


def repeat_callers(active: DataFrame, claims: DataFrame) -> DataFrame:
    """Single and repeated claim callers among active accounts, per month.

    Year and month are compared.
    """
    present = active.select(KEY, month_start("dt").alias("month")).distinct()
    calls = claims.groupBy(KEY, month_start("start_date").alias("month")).agg(
        F.count_distinct("interaction_id").alias("calls")
    )
    classed = calls.join(present, [KEY, "month"], "left_semi").withColumn(
        "category", bucket([(F.col("calls") == 1, "Single Callers")], "Repeated Callers")
    )
    return classed.groupBy("month", "category").agg(F.count(KEY).alias("accounts"))


def last_seen_churn(active: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Accounts by the last day they were seen, for days of a period."""
    last = active.groupBy(KEY).agg(F.max("dt").alias("last_seen"))
    kept = last.where(F.col("last_seen").between(to_date_lit(start), to_date_lit(end)))
    return kept.groupBy("last_seen").agg(F.count(KEY).alias("accounts"))


def reactivation_gaps(active: DataFrame, min_days: int = 1) -> DataFrame:
    """Accounts per day on which they came back after a gap."""
    return gaps(active, [KEY], "dt", min_days).groupBy("dt").agg(F.count(KEY).alias("accounts"))


def interaction_then_disconnect(
    active: DataFrame, interactions: DataFrame, orders: DataFrame, days: int = 40
) -> DataFrame:
    """Number of active accounts with a disconnect within ``days`` days after an
    interaction."""
    accounts = active.select(KEY).distinct()
    touched = interactions.select(KEY, "start_date").join(accounts, KEY, "left_semi")
    out = orders.where(F.col("order_type") == "DEACTIVATION").select(KEY, "order_start")
    hits = nearest_in_window(touched, out, KEY, "start_date", "order_start", 0, days, "disconnected")
    return hits.agg(F.count_distinct(KEY).alias("accounts"))


def users_with_interaction(df: DataFrame, interactions: DataFrame, purpose: str) -> DataFrame:
    """Broadband accounts on first days of months that ever had an interaction
    of one purpose, per month."""
    base = first_of_month(df, "dt").where(F.col("bb_prod").isNotNull())
    wanted = interactions.where(F.col("purpose") == purpose).select(KEY).distinct()
    return count_distinct(
        base.join(wanted, KEY, "left_semi"), {"month": month_start("dt")}, KEY, "accounts"
    ).withColumn("purpose", F.lit(purpose))


def users_with_orders_and_interactions(df: DataFrame, orders: DataFrame, interactions: DataFrame) -> DataFrame:
    """Accounts on first days of months with both an order and an interaction."""
    base = first_of_month(df, "dt")
    both = base.join(orders.select(KEY).distinct(), KEY, "left_semi").join(
        interactions.select(KEY).distinct(), KEY, "left_semi"
    )
    return count_distinct(both, {"month": month_start("dt")}, KEY, "accounts")
