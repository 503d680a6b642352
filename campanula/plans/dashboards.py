"""The three campaign dashboards: email, outbound call, inbound call."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import days_between, month_start
from campanula.functions.rules import bucket, flag, neq_or_null
from campanula.functions.text import matches
from campanula.operators.joining import join_left
from campanula.operators.snapshot import latest_row
from campanula.plans import attribution as at
from campanula.plans.customers import control_group_two
from campanula.plans.pricing import (
    DISCOUNT,
    bundle_up,
    code_weights,
    discounted_arpu_change,
    has_dvr,
    old_new_price,
    package_price_panel,
    price_delta,
)

KEY = "account_no"


def order_weights(orders: DataFrame) -> DataFrame:
    """How often each package is ordered: enough to balance joins on the package of an order."""
    return code_weights(orders.select(bundle_up().alias("new_bundle")), "new_bundle")


def _product_change(df: DataFrame, old_code: str) -> DataFrame:
    return df.withColumns(
        {"rgu_change": at.rgu_change(old_code, "new_bundle"), "rgu_category": at.rgu_category(old_code, "new_bundle")}
    )


def email_outcomes(
    feedback: DataFrame,
    recommendations: DataFrame,
    orders: DataFrame,
    prices: DataFrame,
    front_book: DataFrame,
    *,
    since: dt.date | str,
    days: int = 30,
    excluded_bundles: Sequence[str] = (at.EXCLUDED_BUNDLE,),
) -> DataFrame:
    """One row per emailed account: best matching order, price change, outcome."""
    # of an account's emails of one day, and of its recommendations of one
    # package and day, only the first can win below: the rest go before the
    # two are matched
    engaged = latest_row(at.email_engagement(feedback, since), ["account", "date_sent"], [F.col("email_id").asc()])
    offered = latest_row(recommendations, [KEY, "to_code", "rec_date"], [F.col("rec_id").asc()])
    matched = at.email_offer_match(engaged, offered, since)
    credited = at.attribute_orders(matched, orders, touch_dt="date_sent", days=days)
    touch_order = [
        flag(F.col("order_date") >= F.col("date_sent")).desc(),
        F.col("date_sent").desc(),
        F.col("email_id").asc(),
        F.col("rec_id").asc(),
    ]
    pairs = at.attach_orders(
        matched,
        credited,
        key=KEY,
        target="to_code",
        touch_day="date_sent",
        touch_ids=["email_id", "rec_id"],
        touch_order=touch_order,
    )
    priced = old_new_price(
        pairs.withColumn("old_dvr", has_dvr("stb")),
        package_price_panel(prices, "max"),
        front_book,
        old_code="from_code",
        new_code="new_bundle",
        weights=(code_weights(recommendations, "from_code"), order_weights(orders)),
    )
    best = at.best_touch_per_account(
        priced.withColumn("exact_target", bucket([(F.col("to_code") == F.col("new_bundle"), 1)], 2)),
        [F.col("exact_target").asc(), F.col("new_price").desc_nulls_last(), *touch_order, F.col("order_no").asc()],
    ).where(neq_or_null_any("new_bundle", excluded_bundles))
    judged = at.migration_flags(best, sent="date_sent", target="to_code", days=days)
    judged = price_delta(judged, promised="payment_dif").withColumns(
        {
            "arpu_dif": discounted_arpu_change("discount", "new_bundle", "to_code"),
            "discount_applied": flag(
                (F.col("prior_to_sent") == 0) & (F.col("discount") == DISCOUNT) & (F.col("new_bundle") == F.col("to_code"))
            ),
            "final_group": bucket(
                [
                    (F.col("regime") == "control_x", "control_x"),
                    (F.col("regime") == "control_j", "control_j"),
                    (F.col("discount") == DISCOUNT, "offerfit_disc"),
                ],
                "offer_fit_no_disc",
            ),
        }
    )
    return _product_change(judged, "from_code").withColumns(
        {
            "contacted": flag((F.col("prior_to_sent") == 0) | F.col("prior_to_sent").isNull()),
            "converted": flag((F.col("migrated_one_month") == 1) & (F.col("positive_price_dif") == 1)),
            "converted_downgrade": flag((F.col("migrated_one_month") == 1) & (F.col("negative_price_dif") == 1)),
            "month_migration": at.month_of("migrated", "order_date"),
        }
    )


def email_performance(*tables: DataFrame, snapshots: DataFrame, **options) -> DataFrame:
    """The email dashboard: outcomes with city, address and tenure class."""
    return at.enrich_city_tenure(email_outcomes(*tables, **options), snapshots)


def neq_or_null_any(c: str, values: Sequence[str]) -> Column:
    out = F.lit(True)
    for value in values:
        out = out & neq_or_null(c, value)
    return out


def email_credits(email: DataFrame) -> DataFrame:
    """Accounts the email channel won, with the month of the change."""
    return email.where(F.col("migrated_one_month") == 1).select(
        KEY, F.col("date_sent").alias("mail_sent"), F.col("month_migration").alias("mail_month")
    )


def outbound_outcomes(
    recommendations: DataFrame,
    call_feedback: DataFrame,
    orders: DataFrame,
    prices: DataFrame,
    front_book: DataFrame,
    mail: DataFrame,
    *,
    since: dt.date | str,
    until: dt.date | str,
    days: int = 30,
    excluded_bundles: Sequence[str] = (at.EXCLUDED_BUNDLE,),
    contact_pattern: str = at.CONTACT_PATTERN,
    accept_pattern: str = at.ACCEPT_PATTERN,
) -> DataFrame:
    """One row per called account, with credit withheld where email won first.

    ``mail`` holds the accounts the email channel won (:func:`email_credits`).
    """
    recs = at.inbound_recommendations(recommendations, since, until)
    touches = recs.join(at.outbound_calls(call_feedback, since), KEY)
    credited = at.attribute_orders(touches, orders, touch_dt="rec_date", days=days)
    touch_order = [
        flag(F.col("call_date") >= F.col("rec_date")).desc(),
        flag(F.col("order_date") >= F.col("call_date")).desc(),
        F.col("rec_date").desc(),
        F.col("rec_id").asc(),
    ]
    pairs = at.attach_orders(
        touches,
        credited,
        key=KEY,
        target="recommendedpkg",
        touch_day="rec_date",
        touch_ids=["rec_id"],
        touch_order=touch_order,
    )
    priced = old_new_price(
        pairs.withColumn("old_dvr", has_dvr("stb")),
        package_price_panel(prices, "min"),
        front_book,
        old_code="pkg_cde",
        new_code="new_bundle",
        weights=(code_weights(recommendations, "pkg_cde"), order_weights(orders)),
    )
    best = at.best_touch_per_account(
        priced.withColumn("exact_target", bucket([(F.col("recommendedpkg") == F.col("new_bundle"), 1)], 2)),
        [F.col("exact_target").asc(), F.col("new_price").desc_nulls_last(), *touch_order, F.col("order_no").asc()],
    ).where(neq_or_null_any("new_bundle", excluded_bundles))
    judged = at.migration_flags(best, sent="rec_date", call="call_date", target="recommendedpkg", days=days)
    judged = _product_change(price_delta(judged), "pkg_cde").withColumns(
        {
            "contacted": flag(
                ((F.col("prior_to_sent") == 0) | F.col("prior_to_sent").isNull())
                & (F.col("rec_date") <= F.col("call_date"))
                & matches("disposition", contact_pattern)
            ),
            "outbound_month": at.month_of("migrated_one_month", "order_date"),
        }
    )
    joined = judged.join(mail, KEY, "left").withColumns(
        {
            "exclude_mail": flag(F.col("mail_month") >= F.col("outbound_month")),
            "previous_mail": flag(F.col("mail_month") < F.col("outbound_month")),
        }
    )
    won = (F.col("migrated_one_month") == 1) & (F.col("exclude_mail") == 0) & matches("disposition", accept_pattern)
    return joined.withColumns(
        {
            "email_id": F.lit(" "),
            "converted": flag(won & (F.col("positive_price_dif") == 1)),
            "converted_downgrade": flag(won & (F.col("negative_price_dif") == 1)),
            "final_group": F.lit("Offerfit"),
        }
    )


def outbound_performance(*tables: DataFrame, snapshots: DataFrame, **options) -> DataFrame:
    """The outbound dashboard: outcomes with city, address and tenure class."""
    return at.enrich_city_tenure(outbound_outcomes(*tables, **options), snapshots)


def outbound_credits(outbound: DataFrame, accept_pattern: str = at.ACCEPT_PATTERN) -> DataFrame:
    """Accounts the outbound channel won, with the month of the change."""
    return outbound.where(
        (F.col("migrated_one_month") == 1)
        & (F.col("exclude_mail") == 0)
        & (F.col("call_before_migration") == 1)
        & matches("disposition", accept_pattern)
    ).select(KEY, F.col("rec_date").alias("outbound_rec"), F.col("outbound_month").alias("outbound_month"))


def inbound_periods(
    recommendations: DataFrame,
    interactions: DataFrame,
    orders: DataFrame,
    prices: DataFrame,
    front_book: DataFrame,
    *,
    periods: Sequence[at.Period],
    days: int = 30,
) -> DataFrame:
    """Inbound results: one row per period and account that called back in it.

    The period is a key beside the account, so every input is read once for
    all periods.
    """
    by = ["period"]
    recs = at.in_periods(at.dated_recommendations(recommendations), "rec_date", periods)
    # same-day recommendations of an account differ in nothing the choice
    # below looks at, so one per day is enough
    recs = latest_row(recs, [KEY, *by, "rec_date"], [F.col("rec_id").asc()]).withColumn("group_type", control_group_two(KEY))
    calls = at.in_periods(at.all_inbound_calls(interactions), "call_date", periods)
    answered = at.attribute_calls(recs, calls, by=by, days=days)
    latest = at.latest_orders_by_period(orders, periods).select(
        KEY, *by, "order_no", "order_date", "ord_typ", "new_bundle", "new_dvr"
    )
    joined = answered.join(latest, [KEY, *by], "left").withColumn("days_to_order", days_between("rec_date", "order_date"))
    best = at.best_touch_per_account(
        joined,
        [
            flag(F.col("days_to_order") >= 0).desc(),
            F.col("days_to_order").asc_nulls_last(),
            F.col("rec_date").desc(),
            F.col("call_date").desc(),
            F.col("rec_id").asc(),
        ],
        by=by,
    )
    priced = old_new_price(
        best.withColumn("old_dvr", has_dvr("stb")),
        package_price_panel(prices, "min"),
        front_book,
        old_code="pkg_cde",
        new_code="new_bundle",
        weights=(code_weights(recommendations, "pkg_cde"), order_weights(orders)),
    )
    judged = at.migration_flags(
        priced, sent="rec_date", first_call="first_call", last_call="last_call", target="recommendedpkg", days=days
    )
    return _product_change(price_delta(judged), "pkg_cde").withColumn("rec_month", month_start("rec_date"))


def inbound_month(*tables: DataFrame, start: dt.date | str, end: dt.date | str, days: int = 30) -> DataFrame:
    """Inbound result of one period: one row per account that called back."""
    return inbound_periods(*tables, periods=[(start, end)], days=days).drop("period")


def cross_channel_exclusion(df: DataFrame, mail: DataFrame, outbound: DataFrame, month: str = "rec_month") -> DataFrame:
    """Mark accounts another channel won in the same or a later month
    (excluded), or by email in an earlier one."""
    return join_left(df, [(mail, KEY), (outbound, KEY)]).withColumns(
        {
            "exclude_mail": flag(F.col("mail_month") >= F.col(month)),
            "previous_mail": flag(F.col("mail_month") < F.col(month)),
            "exclude_outbound": flag(F.col("outbound_month") >= F.col(month)),
        }
    )


def conversion_outcome(df: DataFrame) -> DataFrame:
    """Contacted, converted and converted to a cheaper plan."""
    def clean(c: str) -> Column:
        return (F.col(c) == 0) | F.col(c).isNull()

    own = (
        clean("prior_to_sent") & clean("prior_to_call") & (F.col("exclude_mail") == 0) & (F.col("exclude_outbound") == 0)
    )
    won = own & (F.col("migrated") == 1) & (F.col("call_after_rec") == 1)
    return df.withColumns(
        {
            "contacted": flag(own & F.col("call_date").isNotNull()),
            "converted": flag(won & (F.col("price_dif") > 0)),
            "converted_downgrade": flag(won & (F.col("price_dif") < 0)),
        }
    )


def inbound_performance(inbound: DataFrame, mail: DataFrame, outbound: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All periods (:func:`inbound_periods`), one row per account, credited
    against the accounts the email and outbound channels won."""
    one = latest_row(
        inbound,
        [KEY],
        [
            F.col("prior_to_sent").asc_nulls_last(),
            F.col("prior_to_call").asc_nulls_last(),
            F.col("call_after_rec").desc(),
            F.col("migrated").desc(),
            F.col("rec_date").desc(),
            F.col("rec_id").asc(),
            F.col("period").asc(),
        ],
    ).drop("period")
    excluded = cross_channel_exclusion(one, mail, outbound)
    judged = conversion_outcome(excluded).withColumn("email_id", F.lit(" "))
    return at.enrich_city_tenure(judged, snapshots)
