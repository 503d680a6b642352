"""Tying orders and calls to earlier contacts, and judging what followed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import (
    ColumnOrName,
    as_col,
    days_between,
    month_start,
    parse_date,
    parse_yyyymmdd,
    to_date_lit,
)
from campanula.functions.rules import bucket, flag
from campanula.functions.text import matches, speed_mbps
from campanula.operators.joining import interval_join, nearest_in_window
from campanula.operators.snapshot import latest_row, latest_tied_rows, latest_ties
from campanula.plans.pricing import bundle_up, has_dvr

KEY = "account_no"
Period = tuple["dt.date | str", "dt.date | str"]  # first and last day
# --- fixed values -----------------------------------------------------------
# order types that are not a customer's decision to change the plan
EXCLUDED_ORDER_TYPES = ("CONNECT", "V_DISCO", "NON PAY", "RESTART")
# sales and interaction areas that count as an inbound call
INBOUND_AREAS = (
    "c2max|teleperformance|dispute|live|nps|assurance|outbound.+project|^retention^|social|tsi"
    "|voip.+cssr|callcenter|sales.+cssr"
)
INBOUND_MEDIA = "phone|contact.+center"
# dispositions: spoken to, and accepted
CONTACT_PATTERN = "ofiti.+cliente.+acepta"
ACCEPT_PATTERN = "ofiti.+cliente.acepta"
EXCLUDED_BUNDLE = "RJ2F5"
# ---------------------------------------------------------------------------


def plan_orders(orders: DataFrame) -> DataFrame:
    return orders.where(~F.col("ord_typ").isin(*EXCLUDED_ORDER_TYPES))


def attribute_orders(
    touches: DataFrame,
    orders: DataFrame,
    *,
    key: str = KEY,
    touch_dt: str = "touch_date",
    order_dt: str = "order_date",
    order_ts: str = "order_ts",
    days: int = 30,
) -> DataFrame:
    """Orders credited to a contact: per account, those at the latest time that
    lies within ``days`` days after any contact.

    An order follows some contact closely exactly if it follows the last
    contact before it closely, so contacts and order days are merged in time
    order instead of being paired.
    """
    eligible = plan_orders(orders)
    matched = nearest_in_window(
        eligible.select(key, order_dt), touches.select(key, touch_dt), key, order_dt, touch_dt, -days, 0, "last_touch"
    )
    credited = eligible.join(matched, [key, order_dt])
    return latest_tied_rows(credited, [key], F.col(order_ts).desc())


def attach_orders(
    touches: DataFrame,
    credited: DataFrame,
    *,
    key: str,
    target: str,
    touch_day: str,
    touch_ids: Sequence[str],
    touch_order: Sequence[Column],
    order_dt: str = "order_date",
) -> DataFrame:
    """Contacts with the orders they may have led to, ready for a best-pair choice.

    The choice ranks pairs by whether the order took the offered package, by
    its price, then by properties of the contact.  Only one contact per offered
    package and one order per package taken can win, so the rest go before
    anything is paired.  Contacts first shrink to one per package and day,
    which bounds an account by calendar and catalogue before it is shuffled as
    a whole.  ``touch_order`` ends in ``touch_ids`` and may use the account's
    order day, present on every contact.
    """
    daily = latest_row(touches, [key, target, touch_day], [F.col(c).asc() for c in touch_ids])
    taken = credited.select(
        key, order_dt, "order_no", "ord_typ", bundle_up().alias("new_bundle"), has_dvr("stb_sc").alias("new_dvr")
    )
    best_order = latest_row(taken, [key, "new_bundle", "new_dvr"], [F.col("order_no").asc()])
    choices = best_order.groupBy(key).agg(
        F.max(order_dt).alias(order_dt),
        F.collect_list(F.struct("order_no", "ord_typ", "new_bundle", "new_dvr")).alias("_choices"),
    )
    timed = daily.join(choices, key, "left")
    best_touch = latest_row(timed, [key, target], touch_order)
    return best_touch.select(
        *[c for c in best_touch.columns if c != "_choices"], F.explode_outer("_choices").alias("_choice")
    ).select("*", "_choice.*").drop("_choice")


def in_periods(df: DataFrame, day: str, periods: Sequence[Period], name: str = "period") -> DataFrame:
    """Rows whose ``day`` lies in a period, once for each, with the period's number.

    The number is a key like the account: what follows works on all periods in
    one pass, whatever their number.  Periods may overlap.  The range of all of
    them is a plain filter that reaches the scan.
    """
    spans = F.array(
        *[F.struct(F.lit(i).alias("n"), to_date_lit(a).alias("a"), to_date_lit(b).alias("b")) for i, (a, b) in enumerate(periods)]
    )
    inside = df.where(F.col(day).between(to_date_lit(min(a for a, _ in periods)), to_date_lit(max(b for _, b in periods))))
    numbers = F.transform(F.filter(spans, lambda p: F.col(day).between(p["a"], p["b"])), lambda p: p["n"])
    return inside.withColumn(name, F.explode(numbers))


def attribute_calls(
    recs: DataFrame,
    calls: DataFrame,
    *,
    key: str = KEY,
    by: Sequence[str] = (),
    rec_dt: str = "rec_date",
    call_dt: str = "call_date",
    days: int = 30,
) -> DataFrame:
    """Recommendations answered by a call within ``days`` days, with the latest
    such call and the account's first and last call; ``by`` are further keys
    both sides share, such as a period."""
    keys = [key, *by]
    latest = nearest_in_window(recs, calls, keys, rec_dt, call_dt, 0, days, "call_date")
    span = calls.groupBy(*keys).agg(F.min(call_dt).alias("first_call"), F.max(call_dt).alias("last_call"))
    return recs.join(latest, [*keys, rec_dt]).join(span, keys)


def latest_orders_by_period(
    orders: DataFrame, periods: Sequence[Period], area: str = INBOUND_AREAS, *, key: str = KEY
) -> DataFrame:
    """Per account and period, the latest order that was sold in a matching
    area and names one package."""
    sold = plan_orders(orders).where(matches("salesrep_area", area))
    named = in_periods(sold, "order_date", periods).withColumns({"new_bundle": bundle_up(), "new_dvr": has_dvr("stb_sc")}).where(
        F.col("new_bundle").isNotNull()
    )
    return latest_row(named, [key, "period"], [F.col("order_ts").desc(), F.col("order_no").asc()])


def latest_order_in_period(
    orders: DataFrame, start: dt.date | str, end: dt.date | str, area: str = INBOUND_AREAS, *, key: str = KEY
) -> DataFrame:
    """:func:`latest_orders_by_period` for one period."""
    return latest_orders_by_period(orders, [(start, end)], area, key=key).drop("period")


def best_touch_per_account(df: DataFrame, order_spec: Sequence[Column], key: str = KEY, by: Sequence[str] = ()) -> DataFrame:
    """One row per account (and further keys), by an explicit priority that ends in unique ids."""
    return latest_row(df, [key, *by], order_spec)


def before_or_known(order_date: ColumnOrName, mark: ColumnOrName, bundle: ColumnOrName) -> Column:
    """1 when the order came before the mark, 0 when it did not and its package
    is known, NULL when nothing is known."""
    return bucket([(as_col(order_date) < as_col(mark), 1), (as_col(bundle).isNotNull(), 0)])


def migration_flags(
    df: DataFrame,
    *,
    sent: str,
    order: str = "order_date",
    bundle: str = "new_bundle",
    target: str,
    call: str | None = None,
    first_call: str | None = None,
    last_call: str | None = None,
    days: int = 30,
) -> DataFrame:
    """Flags on where the plan change lies relative to send and call.

    ``call`` is the single call of an outbound contact; an inbound contact has
    ``first_call`` and ``last_call`` instead; an email has neither.  The
    "prior" flags keep three states: 1, 0 and NULL.
    """
    o, s = F.col(order), F.col(sent)
    in_month = o <= F.date_add(s, days)
    out = df.withColumn("prior_to_sent", before_or_known(order, sent, bundle))
    clean = F.col("prior_to_sent") == 0
    if call is None and first_call is None:
        migrated, month = clean, clean & in_month
    else:
        lo, hi = (call, call) if first_call is None else (first_call, last_call)
        out = out.withColumn("prior_to_call", before_or_known(order, lo, bundle))
        followed = F.col(call) <= o if first_call is None else s <= F.col(hi)
        out = out.withColumn("call_before_migration" if first_call is None else "call_after_rec", flag(followed))
        migrated = clean & (F.col("prior_to_call") == 0) & followed
        month = clean & in_month & (s <= F.col(hi)) & (F.col(lo) <= o)
    return out.withColumns(
        {
            "migrated": flag(migrated),
            "migrated_one_month": flag(month),
            "different_offer": flag(F.col(target) != F.col(bundle)),
            "accepted_recommendation": flag(F.col(target) == F.col(bundle)),
        }
    )


def product_count(code: ColumnOrName) -> Column:
    """Products in a package.  The second character is a bit mask of the three
    products; anything but 1 to 7 counts as none."""
    mask = F.substring(as_col(code), 2, 1).try_cast("int")
    return F.when(mask.between(1, 7), F.bit_count(mask)).otherwise(0)


def rgu_change(old_code: ColumnOrName, new_code: ColumnOrName) -> Column:
    return F.when(as_col(new_code).isNotNull(), product_count(new_code) - product_count(old_code))


def rgu_category(old_code: ColumnOrName, new_code: ColumnOrName) -> Column:
    change = rgu_change(old_code, new_code)
    return bucket([(change == 0, "upsell"), (change > 0, "crossell_up"), (change < 0, "crossell_down")])


def tenure_bucket(years: ColumnOrName) -> Column:
    y = as_col(years)
    return bucket(
        [
            (y.between(0, 0.5), "0_6_months"),
            ((y > 0.5) & (y <= 1), "6_12_months"),
            ((y > 1) & (y <= 2), "1_2_years"),
            (y > 2, "more_than_2_years"),
        ]
    )


def latest_city_tenure(snapshots: DataFrame, key: str = KEY) -> DataFrame:
    """City, address and tenure class of each account's latest snapshot, in one
    aggregation that is combined before its shuffle; of snapshots of one day
    the greatest values count."""
    place = F.struct("city", "addr1", "tenure")
    order = F.struct("as_of", "city", "addr1", "tenure")
    latest = snapshots.groupBy(key).agg(F.max_by(place, order).alias("_place"))
    return latest.select(key, "_place.city", "_place.addr1", tenure_bucket("_place.tenure").alias("tenure_class"))


def enrich_city_tenure(df: DataFrame, snapshots: DataFrame, key: str = KEY) -> DataFrame:
    """Add latest city, address and tenure class.

    The history shrinks to one row per account while it is read, and the
    accounts at hand are read once; nothing is written in between.  Where the
    history is large, Spark filters it by the accounts of the other side while
    it scans (runtime Bloom filter).
    """
    return df.join(latest_city_tenure(snapshots, key), key, "left")


def email_engagement(feedback: DataFrame, since: dt.date | str) -> DataFrame:
    """Rows of each campaign's last extract, dates parsed, opens and clicks flagged."""
    parsed = latest_ties(feedback, ["campaign_title"], "dt").withColumns(
        {name: parse_yyyymmdd(name) for name in ("date_sent", "date_opened", "date_clicked", "extracted")}
    )
    return parsed.where(F.col("date_sent") >= to_date_lit(since)).withColumns(
        {"opened": flag(F.col("date_opened").isNotNull()), "clicked": flag(F.col("date_clicked").isNotNull())}
    )


def email_offer_match(engagement: DataFrame, offers: DataFrame, since: dt.date | str, key: str = KEY) -> DataFrame:
    """Emails sent on the day of a recommendation or the day after."""
    recs = offers.where(F.col("rec_date") >= to_date_lit(since)).withColumns(
        {
            "speed_dif": speed_mbps("new_speed") - speed_mbps("old_speed"),
            "payment_dif": F.col("payment_dif").try_cast("int"),
        }
    )
    sent = engagement.withColumn(key, F.col("account").try_cast("bigint")).drop("account")
    return interval_join(recs, sent, key, "rec_date", "date_sent", 0, 1)


def dated_recommendations(recs: DataFrame) -> DataFrame:
    """Recommendations with their day; ``'0'`` marks a missing date."""
    return recs.where(F.col("date_text") != "0").withColumn("rec_date", parse_date(F.substring("date_text", 1, 10), "yyyy-MM-dd"))


def inbound_recommendations(recs: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Recommendations of a period."""
    return dated_recommendations(recs).where(F.col("rec_date").between(to_date_lit(start), to_date_lit(end)))


def all_inbound_calls(interactions: DataFrame) -> DataFrame:
    return interactions.where(matches("channel", INBOUND_AREAS) & matches("info", INBOUND_MEDIA)).select(
        KEY, F.col("start_date").alias("call_date")
    )


def inbound_calls(interactions: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return all_inbound_calls(interactions).where(F.col("call_date").between(to_date_lit(start), to_date_lit(end)))


def outbound_calls(feedback: DataFrame, since: dt.date | str) -> DataFrame:
    """Latest dialled call per account."""
    dialled = feedback.where(F.col("dial_text") != "").select(
        F.col("cuenta").try_cast("bigint").alias(KEY),
        parse_date("dial_text", "M/d/yyyy").alias("call_date"),
        "call_id",
        "disposition",
        "comments",
    )
    latest = latest_row(dialled, [KEY], [F.col("call_date").desc(), F.col("call_id").asc()])
    return latest.where(F.col("call_date") >= to_date_lit(since))


def month_of(flagged: ColumnOrName, order_date: ColumnOrName) -> Column:
    return F.when(as_col(flagged) == 1, month_start(order_date))
