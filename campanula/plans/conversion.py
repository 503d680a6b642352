"""Conversion checks on the communication history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import days_between, epoch_ms_to_date, to_date_lit
from campanula.operators.joining import any_key_lookup, asof_backward
from campanula.operators.snapshot import first_event, latest_row
from campanula.plans.audiences import MIGRATIONS
from campanula.plans.pricing import CODE_LENGTH
from campanula.sources.tables import to_epoch_ms, with_dates_from_ms

KEY = "account_no"

# --- fixed values -----------------------------------------------------------
SERVICE_QUEUES = (
    "Tier2", "PR_TechnicalAssistance_Spa", "CSR_SPA", "Business_Sales", "Business_SPA", "Sales_SPA",
    "Business_Retention", "Business_ENG", "Sales_ENG", "FMC",
)
ANSWERED_ACTIONS = (
    "Answered", "Warm transfer to service by agent", "Transferred To External", "Transferred To Service", "Call Complete",
)
AGENT_AREAS = (
    "C2MAX TECH SUPPORT", "C2MAX TECH SUPPORT FIBER", "TELEPERFORMANCE TECH SUPPORT", "TELEPERFORMANCE CSR",
    "CALLCENTER AGUADILLA", "C2MAX CSR", "NPS CLOSED LOOP", "TELEPERFORMANCE LIVEPERSON", "BUSINESS CSSR", "SALES CSSR",
    "C2MAX SALES", "BUSINESS INSIDE SALES", "C2MAX OA", "ORDER ASSURANCE", "LivePerson", "BUSINESS BAE",
)
# ---------------------------------------------------------------------------


def last_plan_order(orders: DataFrame) -> DataFrame:
    """Latest plan-changing order per account."""
    changed = orders.where(F.lower("ord_typ").isin(*MIGRATIONS))
    return latest_row(changed, [KEY], [F.col("order_date").desc(), F.col("order_no").asc()])


def converted_within_days(
    comms: DataFrame, orders: DataFrame, since: dt.date | str, *, channel: str = "email", days: int = 15
) -> DataFrame:
    """Contacts whose account's last order came on or after the contact and
    within ``days`` days of the send."""
    last = last_plan_order(orders).where(F.col("order_date") >= to_date_lit(since))
    sent = comms.where(
        (F.col("channel") == channel) & F.col("contact_ms").isNotNull() & (F.col("sent_ms") >= to_epoch_ms(since))
    )
    dated = with_dates_from_ms(sent, {"sent_date": "sent_ms", "contact_date": "contact_ms"})
    joined = dated.join(last.select(KEY, "order_no", "order_date", "cable_up", "internet_up", "phone_up"), KEY)
    return joined.where(
        (F.col("order_date") >= F.col("contact_date")) & (days_between("sent_date", "order_date") <= days)
    ).withColumn("days_to_order", days_between("contact_date", "order_date"))


def converted_comms_report(
    history: DataFrame,
    since: dt.date | str,
    campaigns: Sequence[str],
    *,
    channel: str = "email",
    converted_only: bool = True,
) -> DataFrame:
    """Campaign sends with their epoch-ms columns as dates."""
    kept = history.where(
        (F.col("channel") == channel)
        & (F.col("sent_ms") >= to_epoch_ms(since))
        & F.col("campaign").isin(*campaigns)
    )
    if converted_only:
        kept = kept.where(F.col("conv_ms").isNotNull() & F.col("conv_flg"))
    return with_dates_from_ms(
        kept, {"sent_date": "sent_ms", "contact_date": "contact_ms", "conv_date": "conv_ms", "recommended_date": "rec_ms"}
    )


def last_comms_on(last: DataFrame, day: dt.date | str) -> DataFrame:
    """Accounts last emailed on ``day``, with their dates."""
    start = to_epoch_ms(day)
    kept = last.where(F.col("last_email_sent_ms").between(start, start + 86_400_000 - 1))
    return with_dates_from_ms(
        kept,
        {
            "last_email_sent": "last_email_sent_ms",
            "last_email_contact": "last_email_contact_ms",
            "last_email_conv": "last_email_conv_ms",
        },
    )


def first_open_validation(opens: DataFrame, ids: DataFrame, history: DataFrame, since: dt.date | str) -> DataFrame:
    """First recorded open per account beside the open date in the history."""
    recent = opens.where(F.col("sent_at") >= to_date_lit(since))
    first = first_event(recent, ["contact_id"], ["sent_at", "event_time"]).join(ids, "contact_id")
    per_account = first_event(first, [KEY], ["sent_at", "event_time"])
    return history.where(F.col("comm_date") >= to_date_lit(since)).join(per_account, KEY)


def service_call_conversion(calls: DataFrame, offers: DataFrame, as_of: dt.date | str, days: int = 30) -> DataFrame:
    """Answered service calls of the last ``days`` days by accounts with an offer."""
    answered = calls.where(
        F.col("service").isin(*SERVICE_QUEUES)
        & F.col("action").isin(*ANSWERED_ACTIONS)
        & F.col("agent_area").isin(*AGENT_AREAS)
        & (F.col("call_date") >= F.date_sub(to_date_lit(as_of), days))
    )
    return answered.join(offers.select(KEY).distinct(), KEY, "left_semi")


def order_package_prices(orders: DataFrame, prices: DataFrame) -> DataFrame:
    """Orders with the price of any package their products name."""
    coded = orders.withColumns(
        {
            "phone_code": F.substring("phone_up", 1, CODE_LENGTH),
            "cable_code": F.substring("cable_up", 1, CODE_LENGTH),
            "internet_code": F.substring("internet_up", 1, CODE_LENGTH),
            "order_delta": F.col("month_amount") - F.col("before_amount"),
        }
    )
    return any_key_lookup(
        coded.select(KEY, "order_no", "order_delta", "phone_code", "cable_code", "internet_code"),
        prices,
        ["phone_code", "cable_code", "internet_code"],
        "package_code",
        "price",
        "package_price",
    )


def conversions_after_comms(conversions: DataFrame, comms: DataFrame) -> DataFrame:
    """Conversion days with the latest communication on or before them."""
    return asof_backward(conversions, comms, KEY, "conv_date", "comm_date", "last_comm")


def conversion_dates(comms: DataFrame) -> DataFrame:
    return comms.where(F.col("conv_ms").isNotNull()).select(KEY, epoch_ms_to_date("conv_ms").alias("conv_date"))


def last_order_first_bill(orders: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per account's latest plan orders, the first later snapshot billed under
    one of the new codes.

    Snapshots shrink to their first day per account and code since the order
    before they meet the codes of the orders.
    """
    changed = orders.where(F.lower("ord_typ").isin(*MIGRATIONS))
    last = changed.groupBy(KEY).agg(F.max("order_date").alias("last_date"))
    on_last = (
        orders.join(last, KEY)
        .where(F.col("order_date") == F.col("last_date"))
        .select(
            KEY,
            "order_no",
            "ord_typ",
            "last_date",
            F.explode(
                F.array_distinct(
                    F.array(*[F.substring(c, 1, CODE_LENGTH) for c in ("internet_up", "cable_up", "phone_up")])
                )
            ).alias("bill_code"),
        )
    )
    billed = (
        snapshots.select(KEY, "bill_code", "as_of")
        .join(last, KEY)
        .where(F.col("as_of") >= F.col("last_date"))
        .groupBy(KEY, "bill_code")
        .agg(F.min("as_of").alias("first_bill"))
    )
    return (
        on_last.join(billed, [KEY, "bill_code"])
        .groupBy(KEY, "last_date", "ord_typ", "order_no")
        .agg(F.min("first_bill").alias("first_bill"))
    )
