"""Named audiences, composite activations and outcome sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from campanula.functions.dates import parse_date
from campanula.operators.snapshot import latest_snapshot
from campanula.plans import audiences as au
from campanula.registry.base import AS_OF, AS_OF_SQL, day_of, fragment, query
from campanula.registry.business import recency_sql

KEEP = "lower(ord_typ) IN ('upgrade', 'downgrade', 'sidegrade')"
fragment("recent_contacts_1", recency_sql(AS_OF_SQL, "2023-12-31"))
fragment("recent_contacts_3", recency_sql(AS_OF_SQL, "2023-10-31"))
fragment(
    "features",
    f"SELECT a.account_no, b.num_accounts, CASE WHEN cycle_day > 31 THEN NULL ELSE DATE '2024-01-01' + cycle_day - 1 END AS last_bill FROM latest_csr a"
    " JOIN phone_counts b ON a.home_phone IS NOT DISTINCT FROM b.home_phone",
)
# each rule below follows the way the audience is put together by hand: sets
# of ids, built from joins of whole tables
fragment(
    "qualified",
    "SELECT DISTINCT c.account_no FROM customers c LEFT JOIN flagged f ON c.account_no = f.account_no LEFT JOIN features v ON c.account_no = v.account_no"
    " LEFT JOIN offers o ON c.account_no = o.account_no WHERE valid_package AND NOT joint_customer AND NOT welcome_offer AND NOT subsidized"
    " AND customer_type = 'RES' AND package_code = pkg_cde AND num_accounts = 1 AND delinquency_days < 50 AND open_order = false AND trouble_call = false",
)
fragment(
    "retargeted",
    f"SELECT DISTINCT c.account_no FROM customers c LEFT JOIN (SELECT * FROM orders_activity WHERE {KEEP}) o ON c.account_no = o.account_no"
    " WHERE order_date >= DATE '2023-10-31' OR tenure <= 0.5",
)
fragment(
    "cross_eligible",
    "SELECT q.account_no FROM qualified q LEFT JOIN retargeted r ON q.account_no = r.account_no WHERE r.account_no IS NULL",
)
fragment(
    "email_retargeted",
    "SELECT account_no FROM recent_contacts_1 WHERE call_sent_42d OR call_contacted_months OR email_sent_21d",
)
fragment(
    "call_retargeted",
    "SELECT account_no FROM recent_contacts_3 WHERE call_sent_42d OR call_contacted_months OR email_sent_21d UNION"
    f" SELECT account_no FROM orders_activity WHERE {KEEP} AND order_date >= DATE '2023-07-31'",
)
fragment("sidegrade_retargeted", f"SELECT DISTINCT account_no FROM orders_activity WHERE {KEEP} AND order_date >= DATE '2023-07-31'")
fragment("targets", "SELECT DISTINCT account_no FROM offers WHERE regime = 'offerfit'")
fragment(
    "single_today",
    f"SELECT DISTINCT o.account_no FROM offers o JOIN flagged f ON o.account_no = f.account_no WHERE lower(offer_type) = 'single' AND offer_rank = 1"
    f" AND next_best_action_date = {AS_OF_SQL} AND privacy_flag = false",
)
fragment(
    "email_ready",
    f"SELECT DISTINCT c.account_no, last_bill FROM customers c JOIN offers o ON c.account_no = o.account_no JOIN features v ON c.account_no = v.account_no"
    " WHERE hsd = 1 AND lower(channel) = 'email' AND email IS NOT NULL",
)
fragment(
    "links_today",
    f"SELECT DISTINCT account_no FROM offers WHERE link IS NOT NULL AND {day_of('link_ms')} = {AS_OF_SQL}"
    f" AND {day_of('link_exp_ms')} BETWEEN {AS_OF_SQL} + 7 AND {AS_OF_SQL} + 15",
)


def inputs(t) -> au.Inputs:
    return au.Inputs(t.csr, t.account_flags, t.offers, t.orders_activity, t.comms_history)


def base(t, **options):
    return au.wide_base(inputs(t), AS_OF, **options)


def since(column: str, days: int) -> str:
    return f"SELECT account_no FROM last_comms WHERE {day_of(column)} >= {AS_OF_SQL} - {days}"


def upgraded(kind: str, days: int) -> str:
    return f"SELECT DISTINCT account_no FROM orders_activity WHERE lower(ord_typ) = '{kind}' AND order_date >= {AS_OF_SQL} - {days}"


NAMED = {
    "cross_attributes": "SELECT DISTINCT c.account_no FROM customers c JOIN features v ON c.account_no = v.account_no JOIN offers o ON c.account_no = o.account_no"
    " WHERE valid_package AND NOT joint_customer AND NOT welcome_offer AND NOT subsidized AND customer_type = 'RES' AND package_code = pkg_cde AND num_accounts = 1",
    "cross_behaviour": "SELECT c.account_no FROM customers c JOIN flagged f ON c.account_no = f.account_no WHERE delinquency_days <= 50"
    " AND open_order = false AND trouble_call = false",
    "cross_behaviour_strict": "SELECT c.account_no FROM customers c JOIN flagged f ON c.account_no = f.account_no WHERE delinquency_days < 50"
    " AND open_order = false AND trouble_call = false",
    "cross_eligible": "SELECT account_no FROM cross_eligible",
    "cross_retargeting": "SELECT account_no FROM retargeted",
    "single_offer_eligible": "SELECT DISTINCT o.account_no FROM offers o JOIN flagged f ON o.account_no = f.account_no WHERE privacy_flag = false"
    " AND offer_rank = 1 AND lower(offer_type) = 'single'",
    "single_offer_email_eligible": "SELECT DISTINCT e.account_no FROM email_ready e JOIN offers o ON e.account_no = o.account_no WHERE lower(channel) = 'email'"
    f" AND next_best_action_date = {AS_OF_SQL} AND last_bill <= {AS_OF_SQL}",
    "single_offer_recommended": "SELECT DISTINCT account_no FROM offers WHERE lower(offer_type) = 'single' AND offer_rank = 1",
    "multi_offer_recommended": "SELECT DISTINCT o.account_no FROM offers o JOIN customers c ON o.account_no = c.account_no WHERE lower(offer_type) = 'multiple'"
    " AND offer_rank = 1 AND valid_package",
    "multi_offer_outbound_eligible": "SELECT DISTINCT o.account_no FROM offers o JOIN flagged f ON o.account_no = f.account_no WHERE do_not_call = false"
    " AND offer_rank = 1 AND lower(offer_type) = 'multiple' AND lower(channel) = 'call center'",
    "multi_offer_inbound": "SELECT DISTINCT o.account_no FROM customers c JOIN offers o ON o.account_no = c.account_no WHERE valid_package"
    " AND lower(offer_type) = 'multiple' AND offer_rank = 1",
    "target_customers": "SELECT account_no FROM targets",
    "control_customers": "SELECT account_no FROM offers GROUP BY 1 HAVING lower(max(regime)) LIKE '%control%'",
    "email_retargeting": "SELECT account_no FROM email_retargeted",
    "sidegrade_retargeting": "SELECT account_no FROM sidegrade_retargeted",
    "link_eligible": "SELECT account_no FROM links_today",
    "email_contacted_15d": since("last_email_contact_ms", 15),
    "email_contacted_30d": since("last_email_contact_ms", 30),
    "call_contacted_15d": since("last_call_contact_ms", 15),
    "call_contacted_30d": since("last_call_contact_ms", 30),
    "email_sent_15d": since("last_email_sent_ms", 15),
    "email_sent_30d": since("last_email_sent_ms", 30),
    "sidegrade_converted_90d": upgraded("sidegrade", 90),
    "sidegrade_converted_180d": upgraded("sidegrade", 180),
    "upgrade_converted_90d": upgraded("upgrade", 90),
    "upgrade_converted_180d": upgraded("upgrade", 180),
}


def _named(name: str, sql: str) -> None:
    @query(f"audience_{name}", sql)
    def _(t):
        return au.named_audience(inputs(t), AS_OF, name)


for _name, _sql in NAMED.items():
    _named(_name, _sql)


@query("audience_call_retargeting", "SELECT account_no FROM call_retargeted")
def _(t):
    return au.named_audience(inputs(t), AS_OF, "call_retargeting", months=3)


@query(
    "audience_cross_eligible_shifted",
    "SELECT q.account_no FROM qualified q JOIN customers c ON q.account_no = c.account_no LEFT JOIN retargeted r ON q.account_no = r.account_no"
    " WHERE r.account_no IS NULL AND CASE WHEN delinquency_days = 0 THEN 0 WHEN delinquency_days > 0 THEN delinquency_days + 2 END < 50",
)
def _(t):
    return au.named_audience(inputs(t), AS_OF, "cross_eligible", shift_days=2)


@query(
    "audience_converted_on",
    f"SELECT DISTINCT c.account_no FROM customers c JOIN orders_activity o ON c.account_no = o.account_no WHERE {KEEP} AND order_date = DATE '2024-01-20'",
)
def _(t):
    return au.converted_on(latest_snapshot(t.csr, "as_of"), t.orders_activity, "2024-01-20")


def _call_outcome(name: str, days: int, outcome: Callable[[], Column], condition: str) -> None:
    @query(
        f"audience_{name}",
        f"SELECT DISTINCT CAST(cuenta AS BIGINT) AS account_no FROM call_feedback WHERE dial_text <> '' AND"
        f" CAST(strptime(CASE WHEN dial_text = '' THEN '1/1/1900' ELSE dial_text END, '%m/%d/%Y') AS DATE) >= {AS_OF_SQL} - {days} AND {condition}",
    )
    def _(t):
        calls = t.call_feedback.where(F.col("dial_text") != "").select(
            F.col("cuenta").cast("bigint").alias("account_no"),
            parse_date("dial_text", "M/d/yyyy").alias("call_date"),
            "disposition",
            "not_offered",
            "not_attended",
        )
        return au.call_outcome(calls, AS_OF, days, outcome())


_call_outcome("call_not_offered_15d", 15, lambda: F.col("not_offered"), "not_offered = true")
_call_outcome("call_not_offered_30d", 30, lambda: F.col("not_offered"), "not_offered = true")
_call_outcome("call_not_attended_15d", 15, lambda: F.col("not_attended"), "not_attended = true")
_call_outcome("call_refused_15d", 15, lambda: F.col("disposition") == "Cliente no acepta", "disposition = 'Cliente no acepta'")


@query(
    "email_link_generation_all",
    f"SELECT c.account_no FROM cross_eligible c JOIN email_ready e ON c.account_no = e.account_no JOIN single_today s ON c.account_no = s.account_no"
    f" WHERE last_bill <= {AS_OF_SQL} - 10",
)
def _(t):
    parts = [au.FLAGS, au.PHONES, au.OFFERS, au.MIGRATED]
    return au.email_link_generation_all(base(t, parts=parts), AS_OF)


@query(
    "email_link_generation_target",
    f"SELECT c.account_no FROM cross_eligible c JOIN email_ready e ON c.account_no = e.account_no JOIN single_today s ON c.account_no = s.account_no"
    " JOIN targets t ON c.account_no = t.account_no LEFT JOIN email_retargeted r ON c.account_no = r.account_no"
    f" LEFT JOIN sidegrade_retargeted d ON c.account_no = d.account_no WHERE last_bill <= {AS_OF_SQL} AND r.account_no IS NULL AND d.account_no IS NULL",
)
def _(t):
    return au.email_link_generation_target(base(t), AS_OF)


@query(
    "single_offer_email_activation",
    "SELECT l.account_no FROM links_today l JOIN targets t ON l.account_no = t.account_no",
)
def _(t):
    return au.single_offer_email_activation(base(t, parts=[au.OFFERS]))


@query(
    "multi_offer_call_activation",
    "WITH callable AS (SELECT DISTINCT o.account_no FROM offers o JOIN flagged f ON o.account_no = f.account_no WHERE do_not_call = false"
    " AND lower(offer_type) = 'multiple' AND lower(channel) = 'call center'), called_in AS (SELECT DISTINCT o.account_no FROM customers c JOIN offers o"
    " ON o.account_no = c.account_no WHERE valid_package AND lower(offer_type) = 'multiple' AND offer_rank = 1)"
    " SELECT c.account_no FROM cross_eligible c JOIN callable a ON c.account_no = a.account_no JOIN called_in b ON c.account_no = b.account_no"
    " JOIN targets t ON c.account_no = t.account_no LEFT JOIN call_retargeted r ON c.account_no = r.account_no WHERE r.account_no IS NULL",
)
def _(t):
    return au.multi_offer_call_activation(base(t, months=3), AS_OF)


@query(
    "audience_sizes",
    " UNION ALL ".join(f"SELECT '{n}' AS audience, count(*) AS accounts FROM ({s})" for n, s in NAMED.items()),
)
def _(t):
    """All named audiences in one pass over the wide base."""
    rules = {n: r for n, r in au.named_rules(AS_OF).items() if n in NAMED}
    return au.audience_sizes(base(t), rules)


@query(
    "activate_sets",
    "SELECT DISTINCT c.account_no FROM customers c JOIN targets t ON c.account_no = t.account_no JOIN links_today l ON c.account_no = l.account_no"
    " LEFT JOIN email_retargeted r ON c.account_no = r.account_no LEFT JOIN sidegrade_retargeted d ON c.account_no = d.account_no"
    " WHERE r.account_no IS NULL AND d.account_no IS NULL",
)
def _(t):
    """Set algebra on separately built id sets."""
    tables = inputs(t)
    return au.activate(
        latest_snapshot(t.csr, "as_of"),
        [au.named_audience(tables, AS_OF, "target_customers"), au.named_audience(tables, AS_OF, "link_eligible")],
        [au.named_audience(tables, AS_OF, "email_retargeting"), au.migration_recency(t.orders_activity, AS_OF, 6)],
    )
