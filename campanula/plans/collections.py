"""Daily collections campaign: base, exclusions, tiers, ranking, channels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import days_between, month_start, parse_clock_text, parse_date, to_date_lit
from campanula.functions.keys import first_valid_id
from campanula.functions.rules import bucket
from campanula.functions.text import like_any, like_none
from campanula.operators.grouping import ratio
from campanula.operators.joining import join_left
from campanula.operators.ranking import rank_large
from campanula.operators.snapshot import latest_row, latest_snapshot
from campanula.plans.customers import control_group_digits

KEY = "account"

# --- fixed values -----------------------------------------------------------
AGENT_CAPACITY = 4000
CANDIDATE_CAPACITY = 4000
CONTROL_SHARE = 0.1
TREATMENT_SHARE = 0.9
DAYS_TO_CHURN = 60
# the dialer's seventh field is never an account id
DIALER_FIELDS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12)
INVALID_OUTCOMES = ("invalid", "no dial tone")
# outcomes after which a customer is left alone
SETTLED_OUTCOMES = (
    "%contactado%due%cuenta%",
    "%equivocado%",
    "%cliente%con%da%o%",
    "%cliente%al%d%a%",
    "%cliente%con%reclamo%",
    "%arreglo%de%pago%",
    "%cambio%de%plan%",
    "%success%",
    "%cesada%",
    "%encuesta%",
)
# exclusion-list category patterns -> group
EXCLUSION_PATTERNS = ("%xcluir%", "%cesada%")
PHOENIX_PATTERN = "%hoenix%"
CANDIDATE_PATTERN = "%candidato%"
# days overdue, both ends included -> tranche
TRANCHES = (
    (-3, 5, "1. Heads up contact"),
    (6, 12, "2. After soft dx"),
    (13, 21, "3. Chill week"),
    (22, 41, "4. Retention attempt 1"),
    (42, 58, "5. Chill week"),
    (59, 70, "6. Retention attempt 2"),
    (71, 76, "7. Close to churn"),
)
HIGH_RISK_DAYS = (3, 7, 9, 11, 22, 28, 32, 36, 40, 46, 52, 57, 59, 66, 71, 72, 73, 74, 75)
MEDIUM_RISK_DAYS = (8, 10, 24, 34, 62, 69, 71, 72, 73, 74, 75)
EARLY_CYCLES = ("A", "B", "C")
EARLY_CYCLE_NOTICE_DAYS = (1, 4, 5, 27, 30)
OTHER_CYCLE_NOTICE_DAYS = (1, 4, 5, 14, 17)
# notification calendar: (risk, early cycle?, days overdue) -> reminder for the
# treatment group
RESTRICTION_REMINDER = "SMS-EMAIL:Restriction_reminder"
SUSPENSION_REMINDER = "SMS-EMAIL:Suspension_reminder"
REMINDERS = (
    ("High", True, (8, 10, 14, 17, 21), RESTRICTION_REMINDER),
    ("Medium", True, (7, 9, 11, 14, 17, 21), RESTRICTION_REMINDER),
    ("Low", True, (7, 9, 11, 14, 17, 21, 22), RESTRICTION_REMINDER),
    ("High", False, (8, 10), RESTRICTION_REMINDER),
    ("Medium", False, (7, 9, 11), RESTRICTION_REMINDER),
    ("Low", False, (7, 9, 11), RESTRICTION_REMINDER),
    ("High", True, (39, 47, 50, 54, 57), SUSPENSION_REMINDER),
    ("Medium", True, (39, 47, 50, 54, 57), SUSPENSION_REMINDER),
    ("Low", True, (32, 36, 39, 42, 44, 47, 54, 59, 66), SUSPENSION_REMINDER),
    ("High", False, (21, 27, 30, 39, 47, 50, 54, 57), SUSPENSION_REMINDER),
    ("Medium", False, (21, 27, 30, 39, 47, 50, 54, 57), SUSPENSION_REMINDER),
    ("Low", False, (21, 22, 27, 30, 32, 36, 39, 42, 44, 47, 54, 59, 66), SUSPENSION_REMINDER),
)
# robocall days per risk, treatment group
ROBOCALL_DAYS = {
    "High": (19, 24, 34, 42, 44, 62, 69),
    "Medium": (3, 19, 22, 28, 32, 36, 42, 44, 59, 66),
    "Low": (8, 10, 19, 24, 34, 62, 69),
}
PAYROLL_DAYS = ((10, 17), (26, 31))
WRONG_NUMBER = "n%mero%errado%"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Sources:
    dna: DataFrame
    scores: DataFrame
    payments: DataFrame
    attempts: DataFrame
    history: DataFrame
    tickets: DataFrame
    orders: DataFrame
    exclusions: DataFrame


def technology() -> Column:
    """Access technology: internet decides, then TV, then voice."""
    kinds = ("FTTH", "HFC")
    bb, tv, vo = F.col("bb_media"), F.col("tv_media"), F.col("vo_media")
    return bucket(
        [
            (bb.isin(*kinds), bb),
            (bb.isNull() & tv.isin(*kinds), tv),
            (bb.isNull() & tv.isNull() & vo.isin(*kinds), vo),
        ],
        "Copper",
    )


CONTACTS = ("phone_1", "phone_2", "phone_3", "email")


def delinquency_base(dna: DataFrame, as_of: dt.date | str, adjust_days: int = 0) -> DataFrame:
    """Residential accounts of the newest snapshot that are -3 to 90 days
    overdue on ``as_of``, with amounts and dates worked out."""
    newest = latest_snapshot(dna, "dt").withColumn("snapshot", parse_date("dt", "yyyy-MM-dd"))
    overdue = days_between("snapshot", to_date_lit(as_of)) + F.col("overdue_age")
    kept = newest.where(
        (F.col("mix") != "0P") & (F.col("customer_type") == "Residencial") & overdue.between(-3, 90)
    )
    no_current = F.col("due_m0").isNull()
    next_due = F.when(no_current & (F.col("due_m1") < F.col("snapshot")), F.col("due_m1")).otherwise(F.col("due_m0"))
    open_invoice = F.when(no_current, F.col("bill_m1")).otherwise(F.col("bill_m0"))
    amount = F.col("outstanding_amount")
    return kept.select(
        KEY,
        "customer_name",
        "cycle",
        F.replace("account_status", F.lit("TFS"), F.lit("T")).alias("status"),
        technology().alias("technology"),
        (F.col("outstanding_age") - F.col("overdue_age")).alias("payment_terms"),
        (overdue + adjust_days).alias("days_overdue"),
        F.coalesce("paid_m0", "paid_m1", "paid_m2", "paid_m3").alias("last_payment"),
        *CONTACTS,
        next_due.alias("next_due"),
        open_invoice.alias("open_invoice"),
        F.round(F.when(next_due <= F.col("snapshot"), amount).otherwise(amount - open_invoice), 2).alias("overdue_amount"),
        amount.alias("total_amount"),
        F.date_sub("snapshot", F.col("outstanding_age")).alias("oldest_invoice"),
        F.date_sub("snapshot", F.col("overdue_age")).alias("oldest_due"),
        F.coalesce("bb_product", "tv_product", "vo_product").alias("plan"),
    )


def risk_band(scores: DataFrame) -> DataFrame:
    """Latest week's scores with their band."""
    decile = F.col("decile")
    return latest_snapshot(scores, "week").select(
        KEY,
        "decile",
        "score",
        bucket([(decile <= 2, "High"), (decile.between(3, 8), "Medium")], "Low").alias("risk"),
    )


def recent_payments(payments: DataFrame, as_of: dt.date | str, days: int = 2) -> DataFrame:
    paid_on = parse_date("created_text", "yyyy-MM-dd HH:mm:ss")
    recent = payments.where(paid_on >= F.date_sub(to_date_lit(as_of), days))
    return recent.groupBy(KEY).agg(F.round(F.sum(F.col("amount_text").cast("double")), 2).alias("paid"))


def contact_history(attempts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Last outcome and number of attempts of accounts whose last attempt fell
    into the month of ``as_of``.

    The account id is repaired from the first field that looks like one.
    """
    named = attempts.select(
        first_valid_id([f"field_{i}" for i in DIALER_FIELDS]).alias(KEY),
        "attempt_id",
        "outcome",
        "child_outcome",
        parse_clock_text("call_text").alias("called_at"),
    ).where(F.col(KEY).isNotNull())
    # count and latest attempt in one aggregation, combined before the shuffle
    last = F.max_by(F.struct("outcome", "child_outcome", "called_at"), F.struct("called_at", -F.col("attempt_id")))
    summed = named.groupBy(KEY).agg(F.count(KEY).alias("attempts"), last.alias("_last")).select(KEY, "attempts", "_last.*")
    this_month = summed.where(month_start(F.col("called_at").cast("date")) == F.trunc(to_date_lit(as_of), "MM"))
    return this_month.select(
        KEY, F.lower(F.coalesce("outcome", "child_outcome")).alias("outcome"), "called_at", "attempts"
    )


def contact_rate(history: DataFrame) -> DataFrame:
    """Answered calls over attempts per account, two decimals."""
    named = history.withColumn(KEY, F.coalesce("field_1", "field_2"))
    unanswered = F.col("child_outcome").eqNullSafe("No contesta1")
    return ratio(named, [KEY], ~unanswered, F.col("contact_id").isNotNull(), "contact_rate")


def open_tickets(tickets: DataFrame, as_of: dt.date | str, days: int = 30) -> DataFrame:
    """Entries per account of technical tickets whose last status is open."""
    technical = tickets.where(F.col("purpose").isin("TICKET", "TRUCKROLL"))
    entries = technical.select(KEY, "interaction_id", "purpose", "status", "start_ts").distinct()
    last = latest_row(entries, ["interaction_id"], [F.col("start_ts").desc(), F.col("status").asc()])
    still_open = last.where(
        (F.col("status") == "OPEN") & (F.col("start_ts").cast("date") >= F.date_sub(to_date_lit(as_of), days))
    )
    kept = entries.join(still_open.select("interaction_id"), "interaction_id", "left_semi")
    return kept.groupBy(KEY).agg(F.count("interaction_id").alias("open_tickets"))


def recent_restrictions(orders: DataFrame, as_of: dt.date | str, months: int = 6, key: str = KEY) -> DataFrame:
    """Latest completed transfer order per account with its seller and channel."""
    transfers = orders.where(
        (F.col("order_type") == "TRANSFER")
        & (F.col("order_status") == "COMPLETED")
        & (F.col("order_start") >= F.add_months(to_date_lit(as_of), -months))
    )
    last = latest_row(transfers, [key], [F.col("order_start").desc(), F.col("order_id").asc()])
    kinds = (("VO", "lob_vo_count"), ("BB", "lob_bb_count"), ("TV", "lob_tv_count"))
    mix = F.concat(*[F.when(F.col(c) == 1, F.concat("network_type", F.lit(f"/{k}"))).otherwise("") for k, c in kinds])
    return last.select(
        key,
        F.col("order_id").alias("last_order_id"),
        F.col("order_start").alias("last_order_date"),
        F.col("sales_rep_name").alias("last_sales_rep"),
        F.col("channel_type").alias("last_channel"),
        mix.alias("tech_mix"),
    )


def exclusion_categories(exclusions: DataFrame) -> DataFrame:
    """All categories of an account as one lowered text.

    Categories are a short fixed list, so distinct ones are all that is kept.
    """
    return exclusions.groupBy(KEY).agg(
        F.lower(F.array_join(F.array_sort(F.collect_set("category")), ",")).alias("category")
    )


def customer_group() -> Column:
    """Group from the exclusion category, else from the account digits."""
    category = F.col("category")
    return bucket(
        [
            (like_any(category, EXCLUSION_PATTERNS), "Exclusion"),
            (category.like(PHOENIX_PATTERN), "Phoenix"),
            (category.like(CANDIDATE_PATTERN), "Candidate"),
            (control_group_digits(KEY), "Control_group_1"),
        ],
        "Treatment_group",
    )


def reachable() -> Column:
    return F.col("outcome").isNull() | ~F.col("outcome").isin(*INVALID_OUTCOMES)


def last_plan_change(as_of: dt.date | str) -> Column:
    rep, channel = F.lower("last_sales_rep"), F.lower("last_channel")
    fresh = F.col("last_order_date") >= F.date_sub(to_date_lit(as_of), 2)
    auto = channel.like("%ac19%")
    return bucket(
        [
            (rep.like("%r%b%") & auto & fresh, "Restablecido_auto_48hrs"),
            (rep.like("%r%h%q%") & ~auto & fresh, "Restablecido_manu_48hrs"),
            (rep.like("%d%g%") & auto, "Restringido"),
        ],
        "Servicio_regular",
    )


def campaign_base(s: Sources, as_of: dt.date | str) -> DataFrame:
    """Everything known about an account; each side has one row per account."""
    excluded = exclusion_categories(s.exclusions).withColumn("listed", F.lit(True))
    restrictions = recent_restrictions(
        s.orders.withColumn(KEY, F.col("campaign_account")), as_of
    ).drop("tech_mix")
    joined = join_left(
        delinquency_base(s.dna, as_of),
        [
            (risk_band(s.scores), KEY),
            (recent_payments(s.payments, as_of), KEY),
            (contact_history(s.attempts, as_of), KEY),
            (contact_rate(s.history), KEY),
            (open_tickets(s.tickets, as_of), KEY),
            (excluded, KEY),
            (restrictions, KEY),
        ],
    )
    return joined.withColumns(
        {
            "customer_group": customer_group(),
            "check_phone": bucket([(reachable(), "valid_phone")], "invalid_phone"),
            "plan_change": last_plan_change(as_of),
        }
    )


def churn_date() -> Column:
    due = F.date_add("oldest_due", DAYS_TO_CHURN)
    return F.when(F.col("cycle").like("%A%"), F.add_months(due, 1)).otherwise(due)


def depurate(base: DataFrame) -> DataFrame:
    """Drop accounts that paid, cannot be named, owe nothing, wait for a
    technician or have settled the matter; shift uncalled accounts by a day."""
    kept = base.where(
        F.col("paid").isNull()
        & F.col("customer_name").isNotNull()
        & (F.col("total_amount") > 0)
        & F.col("open_tickets").isNull()
        & like_none("outcome", SETTLED_OUTCOMES)
    )
    shifted = F.col("days_overdue") - F.when(F.col("outcome").isNull(), 1).otherwise(0)
    return kept.withColumns({"overdue": shifted, "churn_date": churn_date()})


def tranche(days: str = "days_overdue") -> Column:
    d = F.col(days)
    return bucket([(d.between(low, high), label) for low, high, label in TRANCHES])


def tier() -> Column:
    """Calling priority.  A candidate that was called before is always tier 2:
    the number of attempts only matters for the Phoenix group."""
    group, risk, d, o = F.col("customer_group"), F.col("risk"), F.col("days_overdue"), F.col("overdue")
    late, new = d > 0, F.col("outcome").isNull()
    early = F.col("cycle").isin(*EARLY_CYCLES)
    high = (risk == "High") & late & o.isin(*HIGH_RISK_DAYS)
    medium = (risk == "Medium") & late & o.isin(*MEDIUM_RISK_DAYS)
    rules = [
        (group == "Candidate") & new,
        (group == "Phoenix") & new,
        (group == "Candidate") | ((group == "Phoenix") & (F.col("attempts") >= 2)),
        (group == "Control_group_1") & late,
        F.col("tranche") == TRANCHES[-1][2],
        high & new,
        high,
        medium & new,
        medium,
        late & new & ~o.isin(*EARLY_CYCLE_NOTICE_DAYS) & early,
        late & new & ~o.isin(*OTHER_CYCLE_NOTICE_DAYS) & ~early,
    ]
    return bucket([(rule, f"Tier_{i:02d}") for i, rule in enumerate(rules)], f"Tier_{len(rules)}")


def rank_within_group(df: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Position of each account within its group and phone validity.

    One group holds most accounts, so positions are worked out by counting
    instead of sorting a group in one task.  ``accounts`` may be a cheaper
    frame with about the same accounts, to take split points from.  The three orderings share one
    ranking: a column that does not count for a group is blanked there.
    """
    control = F.col("customer_group") == "Control_group_1"
    treated = F.col("customer_group") == "Treatment_group"
    keyed = df.withColumns(
        {
            "_tier": F.when(~control, F.col("tier")),
            "_decile": F.when(~control, F.col("decile")),
            "_rate": F.when(control | treated, F.col("contact_rate")),
            "_id": F.col(KEY).cast("bigint"),
        }
    )
    ranked = rank_large(
        keyed, ["customer_group", "check_phone"], [("_tier", False), ("_decile", False), ("_rate", True)], "_id", "rank",
        measured=None if accounts is None else accounts.select(F.col(KEY).cast("bigint").alias("_id")),
    )
    return ranked.withColumn("rank", F.when(F.col("customer_group") != "Exclusion", F.col("rank"))).drop(
        "_tier", "_decile", "_rate", "_id"
    )


def massive_notification() -> Column:
    """Message of the day from the journey calendar; the first line that fits wins."""
    d, risk, listed = F.col("days_overdue"), F.col("risk"), F.coalesce("listed", F.lit(False))
    early = F.col("cycle").isin(*EARLY_CYCLES)
    treated = F.col("customer_group") == "Treatment_group"
    free = ~listed
    unrestricted = d.between(6, 22) & ~F.col("plan").like("%postmora%") & F.col("status").isin("W", "D")
    lines: list[tuple[Column, str]] = [
        (free & (d == -3), "SMS-EMAIL:Prevoverdue"),
        (free & (d == 1), "SMS-EMAIL:Restriction_warning_-4_days"),
        ((free & (d == 4)) | unrestricted, "SMS-EMAIL:Restriction_warning_-24_hrs"),
        (free & (d == 5), "SMS-EMAIL:Restriction"),
        (free & F.when(early, d == 27).otherwise(d == 14) & F.col("cycle").isNotNull(), "SMS-EMAIL:Suspension_warning_-3_days"),
        (free & F.when(early, d == 30).otherwise(d == 17) & F.col("cycle").isNotNull(), "SMS-EMAIL:Suspension"),
    ]
    for level, in_early, days, message in REMINDERS:
        lines.append((free & treated & (risk == level) & (early if in_early else ~early) & d.isin(*days), message))
    lines.append((free & (F.col("customer_group") == "Control_group_1") & (d > 0), "SMS-EMAIL:Generic"))
    return bucket(lines, "NA")


def contact_channel(
    as_of: dt.date | str,
    agent_capacity: int = AGENT_CAPACITY,
    candidate_capacity: int = CANDIDATE_CAPACITY,
) -> Column:
    """Channel of the day: agents up to capacity, then chat, then robocalls."""
    day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    group, rank, d, risk = F.col("customer_group"), F.col("rank"), F.col("days_overdue"), F.col("risk")
    treated = group == "Treatment_group"
    payroll = F.lit(any(low <= day.day <= high for low, high in PAYROLL_DAYS))
    free = ~F.coalesce("listed", F.lit(False))
    lines = [
        ((group == "Candidate") & (rank <= candidate_capacity) & reachable(), "AGENT CALL Candidate"),
        ((F.col("tier") == "Tier_03") & (rank <= agent_capacity * CONTROL_SHARE) & reachable(), "AGENT CALL"),
        (treated & (rank <= agent_capacity * TREATMENT_SHARE) & reachable(), "AGENT CALL"),
        (
            payroll & treated & (rank <= agent_capacity) & (reachable() | ~F.col("outcome").like(WRONG_NUMBER)),
            "Whatsapp",
        ),
    ]
    for level, days in ROBOCALL_DAYS.items():
        lines.append((treated & free & (risk == level) & d.isin(*days), "IVR-Robocall"))
    return bucket(lines, "Silence")


def prioritise(base: DataFrame) -> DataFrame:
    """Exclusions, tranche and tier."""
    return depurate(base).withColumn("tranche", tranche()).withColumn("tier", tier())


def campaign(
    s: Sources,
    as_of: dt.date | str,
    *,
    agent_capacity: int = AGENT_CAPACITY,
    candidate_capacity: int = CANDIDATE_CAPACITY,
) -> DataFrame:
    """The day's campaign list.

    Nothing is written and no job runs before the list is asked for.
    """
    ranked = rank_within_group(prioritise(campaign_base(s, as_of)), latest_snapshot(s.dna, "dt"))
    return ranked.withColumns(
        {
            "notification": massive_notification(),
            "contact_channel": contact_channel(as_of, agent_capacity, candidate_capacity),
            "run_date": to_date_lit(as_of),
        }
    )


def campaign_summary(df: DataFrame, by: Sequence[str] = ("customer_group", "contact_channel", "notification")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("accounts"))
