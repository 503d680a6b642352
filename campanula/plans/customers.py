"""Customer attributes, service flags, derived features and last contacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import ColumnOrName, as_col, cycle_bill_date, date_to_epoch_ms
from campanula.functions.keys import prefixed_account
from campanula.functions.rules import bucket, is_x, true_if
from campanula.functions.text import first_name, last_name, suffix
from campanula.operators.joining import join_left, lookup
from campanula.operators.ranking import distinct_per_partition
from campanula.operators.snapshot import latest_snapshot

# --- fixed values -----------------------------------------------------------
# last two digits of the account number -> test group
CONTROL_A = ("24", "99", "67", "41", "19")
CONTROL_X = ("25", "47", "79", "22", "93")
CONTROL_J = ("26", "48", "80", "23", "94")
# a package is valid when its code starts with one of these letters ...
VALID_DROP = ("R", "F")
# ... followed by one of these product masks
VALID_MASK = ("1", "2", "3", "4", "5", "6", "7")
# ---------------------------------------------------------------------------


def control_group(account: ColumnOrName) -> Column:
    """Three control groups and the target group."""
    tail = suffix(account)
    return bucket(
        [(tail.isin(*CONTROL_A), "Control A"), (tail.isin(*CONTROL_X), "Control X"), (tail.isin(*CONTROL_J), "Control J")],
        "Target",
    )


def control_group_two(account: ColumnOrName) -> Column:
    """The dashboards' grouping: two control groups, the rest is treated."""
    tail = suffix(account)
    return bucket([(tail.isin(*CONTROL_A), "control_A"), (tail.isin(*CONTROL_X), "control_X")], "offerfit")


def control_group_digits(account: ColumnOrName) -> Column:
    """Whether digits seven and eight of the id put it in the control group."""
    return F.substring(as_col(account), 7, 2).try_cast("int").between(3, 9)


def valid_package(code: ColumnOrName) -> Column:
    code = as_col(code)
    return true_if(F.substring(code, 1, 1).isin(*VALID_DROP) & F.substring(code, 2, 1).isin(*VALID_MASK))


def shifted_delinquency(days: ColumnOrName, shift_days: int) -> Column:
    """Days past due moved forward; zero stays, negative counts as unknown."""
    days = as_col(days)
    return bucket([(days > 0, days + shift_days), (days == 0, days)])


def csr_attributes(snapshots: DataFrame, *, latest: bool = True, shift_days: int | None = None) -> DataFrame:
    """One row per account with flags, package validity, test group and contacts."""
    df = latest_snapshot(snapshots, "as_of") if latest else snapshots
    past_due = F.col("delinquency_days") if shift_days is None else shifted_delinquency("delinquency_days", shift_days)
    return df.select(
        "account_no",
        "as_of",
        is_x("welcome_offer").alias("welcome_offer"),
        is_x("acp").alias("subsidized"),
        is_x("joint_customer").alias("joint_customer"),
        valid_package("bill_code").alias("valid_package"),
        control_group("account_no").alias("regime"),
        F.col("addr1").alias("address"),
        F.col("home_phone").alias("phone_1"),
        F.col("bus_phone").alias("phone_2"),
        F.col("cycle_day").alias("invoice_day"),
        "email",
        "customer_type",
        past_due.alias("delinquency_days"),
        "hsd",
        F.col("bill_code").alias("package_code"),
        F.col("res_name").alias("customer_name"),
        first_name("res_name").alias("first_name"),
        last_name("res_name").alias("last_name"),
        "tenure",
    )


def account_flags(flags: DataFrame) -> DataFrame:
    """Privacy, open order, trouble call and do-not-call as booleans."""
    return flags.select(
        "account_no",
        is_x("has_privacy_flag").alias("privacy_flag"),
        is_x("has_open_order").alias("open_order"),
        is_x("pending_tc").alias("trouble_call"),
        is_x("is_in_ndnc").alias("do_not_call"),
    )


def accounts_per_phone(snapshot: DataFrame) -> DataFrame:
    """Accounts of one snapshot with the number that share their phone.

    Accounts without a phone share one hot NULL group, so the counts return
    through the skew-safe lookup, weighted by the very number they carry.
    """
    phones = distinct_per_partition(snapshot, "home_phone", "account_no", "num_accounts")
    return lookup(snapshot.select("account_no", "home_phone"), phones, "home_phone", weight="num_accounts")


def changed_speed(snapshots: DataFrame) -> DataFrame:
    """Whether an account was ever seen with more than one internet speed."""
    return snapshots.groupBy("account_no").agg((F.count_distinct("hsd_speed") > 1).alias("changed_speed"))


def customer_features(snapshots: DataFrame, as_of: dt.date | str, prefix: str = "ACCT_FX_") -> DataFrame:
    """Per account: last bill date, accounts on its phone, ever changed speed.

    Dates leave as epoch milliseconds.
    """
    current = latest_snapshot(snapshots, "as_of")
    base = current.select("account_no", "cycle_day", F.col("as_of").alias("dt"))
    wide = join_left(base, [(accounts_per_phone(current), "account_no"), (changed_speed(snapshots), "account_no")])
    return wide.select(
        prefixed_account("account_no", prefix).alias("account_id"),
        "account_no",
        "home_phone",
        "num_accounts",
        date_to_epoch_ms(cycle_bill_date(as_of, "cycle_day")).alias("last_bill_ms"),
        "changed_speed",
        date_to_epoch_ms("dt").alias("dt_ms"),
    )


def last_contacts(comms: DataFrame) -> DataFrame:
    """Latest send, contact and conversion per account and channel, epoch ms, one pass."""
    email = F.col("channel") == "email"
    call = F.col("channel") == "outbound_call"
    return comms.groupBy("account_no").agg(
        F.max(F.when(email, F.col("sent_ms"))).alias("last_email_sent_ms"),
        F.max(F.when(email, F.col("contact_ms"))).alias("last_email_contact_ms"),
        F.max(F.when(email, F.col("conv_ms"))).alias("last_email_conv_ms"),
        F.max(F.when(call, F.col("sent_ms"))).alias("last_call_sent_ms"),
        F.max(F.when(call, F.col("contact_ms"))).alias("last_call_contact_ms"),
    )
