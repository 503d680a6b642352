"""Audiences: named rules over one wide customer row, and set algebra on ids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import cycle_bill_date, epoch_ms_to_date, shift_months, to_date_lit
from campanula.functions.rules import true_if
from campanula.operators.joining import anti, intersect_ids, join_left, semi
from campanula.operators.snapshot import latest_snapshot
from campanula.plans import offers as off
from campanula.plans.customers import account_flags, accounts_per_phone, csr_attributes, last_contacts

KEY = "account_no"
# --- fixed values -----------------------------------------------------------
MIGRATIONS = ("downgrade", "upgrade", "sidegrade")
TARGET_REGIME = "offerfit"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Inputs:
    """Tables an audience may draw on."""

    snapshots: DataFrame
    flags: DataFrame
    offers: DataFrame
    orders: DataFrame
    comms: DataFrame


def audience(base: DataFrame, rule: Column, key: str = KEY) -> DataFrame:
    """Distinct keys of the rows that fulfil the rule."""
    return base.where(rule).select(key).distinct()


def activate(base: DataFrame, include: list[DataFrame], suppress: list[DataFrame], key: str = KEY) -> DataFrame:
    """Ids of ``base`` that are in every ``include`` and in no ``suppress`` set."""
    return anti(intersect_ids(base, *include, on=key), *suppress, on=key)


def size(ids: DataFrame, key: str = KEY) -> DataFrame:
    """Audience size."""
    return ids.agg(F.count_distinct(key).alias("accounts"))


def last_migration(orders: DataFrame) -> DataFrame:
    """Latest date per account of an order that changed the plan, by kind."""
    kind = F.lower("ord_typ")
    day = F.col("order_date")
    return orders.groupBy(KEY).agg(
        F.max(F.when(kind.isin(*MIGRATIONS), day)).alias("last_migration"),
        F.max(F.when(kind == "sidegrade", day)).alias("last_sidegrade"),
        F.max(F.when(kind == "upgrade", day)).alias("last_upgrade"),
    )


def migration_recency(orders: DataFrame, as_of: dt.date | str, months: int) -> DataFrame:
    """Accounts with a plan change in the last ``months`` months."""
    since = shift_months(as_of, -months)
    recent = orders.where(F.lower("ord_typ").isin(*MIGRATIONS) & (F.col("order_date") >= since))
    return recent.select(KEY).distinct()


def recency_flags(last: DataFrame, as_of: dt.date | str, months: int) -> DataFrame:
    """Recent-contact flags from epoch-ms columns, all in one pass."""
    return last.select(KEY, *[c.alias(n) for n, c in recency_columns(as_of, months).items()])


def recency_columns(as_of: dt.date | str, months: int) -> dict[str, Column]:
    day = to_date_lit(as_of)
    months_ago = shift_months(as_of, -months, sticky=True)
    sent, contacted = epoch_ms_to_date("last_call_sent_ms"), epoch_ms_to_date("last_call_contact_ms")
    email = epoch_ms_to_date("last_email_sent_ms")
    return {
        "call_sent_42d": true_if(sent >= F.date_sub(day, 42)),
        "call_contacted_months": true_if((contacted >= months_ago) & (sent >= months_ago)),
        "email_sent_21d": true_if(email >= F.date_sub(day, 21)),
    }


def offer_summary(offers: DataFrame, as_of: dt.date | str) -> DataFrame:
    """All an audience asks of the offers, one row per account, in one pass.

    The distinct current packages of an account are few, so their set is small
    however many offers an account has.
    """
    day = to_date_lit(as_of)
    single, multiple = off.of_type("single"), off.of_type("multiple")
    email, call, first = off.on_channel("email"), off.on_channel("call center"), F.col("offer_rank") == 1
    today = F.col("next_best_action_date") == day
    facts = {
        "has_single_first": single & first,
        "has_single_first_today": single & first & today,
        "has_multiple_first": multiple & first,
        "has_multiple_call": multiple & call,
        "has_multiple_call_first": multiple & call & first,
        "has_email": email,
        "has_email_today": email & today,
        "is_target": F.col("regime") == TARGET_REGIME,
        "has_link_today": F.col("link").isNotNull()
        & (epoch_ms_to_date("link_ms") == day)
        & epoch_ms_to_date("link_exp_ms").between(F.date_add(day, 7), F.date_add(day, 15)),
    }
    extra = [F.max("regime").alias("top_regime"), F.collect_set("pkg_cde").alias("_offered")]
    return off.offer_facts(offers, facts, KEY, extra)


# parts of the wide base; a rule names those it reads
FLAGS, PHONES, OFFERS, CONTACTS, MIGRATED = "flags", "phones", "offers", "contacts", "migrated"
ALL_PARTS = (FLAGS, PHONES, OFFERS, CONTACTS, MIGRATED)


def wide_base(
    t: Inputs,
    as_of: dt.date | str,
    *,
    parts: Sequence[str] = ALL_PARTS,
    shift_days: int | None = None,
    months: int = 1,
) -> DataFrame:
    """One row per account of the newest snapshot with everything rules need.

    Offers, orders and contacts are each aggregated to one row per account
    first.  All joins are then one row to one row on the account number, so
    Spark shuffles every input once and no account can be hot.  Only the parts
    named are read.
    """
    base = csr_attributes(t.snapshots, shift_days=shift_days).withColumn(
        "last_bill", cycle_bill_date(as_of, "invoice_day")
    )
    dims: list[DataFrame] = []
    if FLAGS in parts:
        dims.append(account_flags(t.flags))
    if PHONES in parts:
        dims.append(accounts_per_phone(latest_snapshot(t.snapshots, "as_of")).drop("home_phone"))
    if OFFERS in parts:
        dims.append(offer_summary(t.offers, as_of))
    if CONTACTS in parts:
        last = last_contacts(t.comms)
        dims.append(last.withColumns(recency_columns(as_of, months)))
    if MIGRATED in parts:
        dims.append(last_migration(t.orders))
    wide = join_left(base, [(dim, KEY) for dim in dims])
    if OFFERS in parts:
        wide = wide.withColumn("same_package", F.array_contains("_offered", F.col("package_code"))).drop("_offered")
    return wide


def cross_attributes_rule() -> Column:
    c = F.col
    return (
        c("valid_package")
        & ~c("joint_customer")
        & ~c("welcome_offer")
        & ~c("subsidized")
        & (c("customer_type") == "RES")
        & c("same_package")
        & (c("num_accounts") == 1)
    )


def cross_behaviour_rule(limit: int = 50, strict: bool = False) -> Column:
    days = F.col("delinquency_days")
    return (days < limit if strict else days <= limit) & ~F.col("open_order") & ~F.col("trouble_call")


def cross_retargeting_rule(as_of: dt.date | str, months: int = 3) -> Column:
    return (F.col("last_migration") >= shift_months(as_of, -months)) | (F.col("tenure") <= 0.5)


def cross_eligible_rule(as_of: dt.date | str) -> Column:
    """Both cross rules and not up for retargeting, all on the same row."""
    return cross_attributes_rule() & cross_behaviour_rule(strict=True) & ~true_if(cross_retargeting_rule(as_of))


def email_eligible_rule(as_of: dt.date | str, back_days: int = 0, today_only: bool = False) -> Column:
    c = F.col
    offered = c("has_email_today") if today_only else c("has_email")
    return (c("hsd") == 1) & offered & c("email").isNotNull() & (c("last_bill") <= F.date_sub(to_date_lit(as_of), back_days))


def single_offer_rule(today_only: bool = False) -> Column:
    return ~F.col("privacy_flag") & F.col("has_single_first_today" if today_only else "has_single_first")


def outbound_call_rule(first_only: bool = True) -> Column:
    return ~F.col("do_not_call") & F.col("has_multiple_call_first" if first_only else "has_multiple_call")


def inbound_call_rule() -> Column:
    return F.col("valid_package") & F.col("has_multiple_first")


def contacted_recently_rule() -> Column:
    return F.col("call_sent_42d") | F.col("call_contacted_months") | F.col("email_sent_21d")


def call_retargeting_rule(as_of: dt.date | str) -> Column:
    recent = F.coalesce(contacted_recently_rule(), F.lit(False))
    return recent | true_if(F.col("last_migration") >= shift_months(as_of, -6))


def sidegrade_retargeting_rule(as_of: dt.date | str) -> Column:
    return F.col("last_migration") >= shift_months(as_of, -6)


@dataclass(frozen=True)
class Rule:
    """A condition on the wide base and the parts of the base it reads."""

    condition: Column
    parts: tuple[str, ...] = ()


def named_rules(as_of: dt.date | str) -> Mapping[str, Rule]:
    """Audience name -> rule."""
    day = to_date_lit(as_of)
    cross = (FLAGS, PHONES, OFFERS)

    def contact(column: str, days: int) -> Rule:
        return Rule(epoch_ms_to_date(column) >= F.date_sub(day, days), (CONTACTS,))

    def converted(column: str, days: int) -> Rule:
        return Rule(F.col(column) >= F.date_sub(day, days), (MIGRATED,))

    return {
        "cross_attributes": Rule(cross_attributes_rule(), (PHONES, OFFERS)),
        "cross_behaviour": Rule(cross_behaviour_rule(), (FLAGS,)),
        "cross_behaviour_strict": Rule(cross_behaviour_rule(strict=True), (FLAGS,)),
        "cross_eligible": Rule(cross_eligible_rule(as_of), (*cross, MIGRATED)),
        "cross_retargeting": Rule(cross_retargeting_rule(as_of), (MIGRATED,)),
        "single_offer_eligible": Rule(single_offer_rule(), (FLAGS, OFFERS)),
        "single_offer_email_eligible": Rule(email_eligible_rule(as_of, today_only=True), (OFFERS,)),
        "single_offer_recommended": Rule(F.col("has_single_first"), (OFFERS,)),
        "multi_offer_recommended": Rule(F.col("has_multiple_first") & F.col("valid_package"), (OFFERS,)),
        "multi_offer_outbound_eligible": Rule(outbound_call_rule(), (FLAGS, OFFERS)),
        "multi_offer_inbound": Rule(inbound_call_rule(), (OFFERS,)),
        "target_customers": Rule(F.col("is_target"), (OFFERS,)),
        "control_customers": Rule(F.lower("top_regime").like("%control%"), (OFFERS,)),
        "email_retargeting": Rule(contacted_recently_rule(), (CONTACTS,)),
        "call_retargeting": Rule(call_retargeting_rule(as_of), (CONTACTS, MIGRATED)),
        "sidegrade_retargeting": Rule(sidegrade_retargeting_rule(as_of), (MIGRATED,)),
        "link_eligible": Rule(F.col("has_link_today"), (OFFERS,)),
        "email_contacted_15d": contact("last_email_contact_ms", 15),
        "email_contacted_30d": contact("last_email_contact_ms", 30),
        "call_contacted_15d": contact("last_call_contact_ms", 15),
        "call_contacted_30d": contact("last_call_contact_ms", 30),
        "email_sent_15d": contact("last_email_sent_ms", 15),
        "email_sent_30d": contact("last_email_sent_ms", 30),
        "sidegrade_converted_90d": converted("last_sidegrade", 90),
        "sidegrade_converted_180d": converted("last_sidegrade", 180),
        "upgrade_converted_90d": converted("last_upgrade", 90),
        "upgrade_converted_180d": converted("last_upgrade", 180),
    }


def named_audience(t: Inputs, as_of: dt.date | str, name: str, **options: int) -> DataFrame:
    """A named audience over just the inputs its rule reads."""
    rule = named_rules(as_of)[name]
    return audience(wide_base(t, as_of, parts=rule.parts, **options), rule.condition)


def converted_on(snapshot: DataFrame, orders: DataFrame, day: dt.date | str) -> DataFrame:
    """Accounts whose plan changed on ``day``."""
    changed = orders.where((F.col("order_date") == to_date_lit(day)) & F.lower("ord_typ").isin(*MIGRATIONS))
    return semi(snapshot.select(KEY).distinct(), changed.select(KEY).distinct(), KEY)


def call_outcome(feedback: DataFrame, as_of: dt.date | str, days: int, outcome: Column, key: str = KEY) -> DataFrame:
    """Accounts called in the last ``days`` days with a given outcome: a flag of
    the feedback, or a condition on its text.  An unknown outcome is none."""
    recent = feedback.where((F.col("call_date") >= F.date_sub(to_date_lit(as_of), days)) & outcome)
    return recent.select(key).distinct()


def email_link_generation_all(base: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Everyone eligible for a mailed link.

    All rules read one wide row per account, so the set algebra is one filter:
    no join remains after the base is built.
    """
    rule = (
        cross_eligible_rule(as_of) & email_eligible_rule(as_of, back_days=10) & single_offer_rule(today_only=True)
    )
    return audience(base, rule)


def email_link_generation_target(base: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Everyone eligible in the target group who was not approached lately."""
    rule = (
        cross_eligible_rule(as_of)
        & email_eligible_rule(as_of)
        & single_offer_rule(today_only=True)
        & F.col("is_target")
        & ~true_if(contacted_recently_rule())
        & ~true_if(sidegrade_retargeting_rule(as_of))
    )
    return audience(base, rule)


def single_offer_email_activation(base: DataFrame) -> DataFrame:
    return audience(base, F.col("has_link_today") & F.col("is_target"))


def multi_offer_call_activation(base: DataFrame, as_of: dt.date | str) -> DataFrame:
    rule = (
        cross_eligible_rule(as_of)
        & outbound_call_rule(first_only=False)
        & inbound_call_rule()
        & F.col("is_target")
        & ~call_retargeting_rule(as_of)
    )
    return audience(base, rule)


def audience_sizes(base: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Sizes of many audiences in one pass over the wide base."""
    counts = base.agg(*[F.count_if(rule.condition).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "audience", "accounts")
