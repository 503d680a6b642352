"""The collections campaign, step by step and as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from campanula.operators import ranking as rk
from campanula.plans import collections as co
from campanula.registry.base import AS_OF, AS_OF_SQL, fragment, query

fragment(
    "debt",
    f"""SELECT account, customer_name, cycle, replace(account_status, 'TFS', 'T') AS status,
 CASE WHEN bb_media IN ('FTTH', 'HFC') THEN bb_media WHEN bb_media IS NULL AND tv_media IN ('FTTH', 'HFC') THEN tv_media
 WHEN bb_media IS NULL AND tv_media IS NULL AND vo_media IN ('FTTH', 'HFC') THEN vo_media ELSE 'Copper' END AS technology,
 outstanding_age - overdue_age AS payment_terms, CAST({AS_OF_SQL} - CAST(dt AS DATE) + overdue_age AS INT) AS days_overdue,
 coalesce(paid_m0, paid_m1, paid_m2, paid_m3) AS last_payment, phone_1, phone_2, phone_3, email, next_due, open_invoice,
 round(CASE WHEN next_due <= CAST(dt AS DATE) THEN outstanding_amount ELSE outstanding_amount - open_invoice END, 2) AS overdue_amount,
 outstanding_amount AS total_amount, CAST(dt AS DATE) - outstanding_age AS oldest_invoice, CAST(dt AS DATE) - overdue_age AS oldest_due,
 coalesce(bb_product, tv_product, vo_product) AS plan FROM (SELECT *, CASE WHEN due_m0 IS NULL AND due_m1 < CAST(dt AS DATE) THEN due_m1 ELSE due_m0 END AS next_due,
 CASE WHEN due_m0 IS NULL THEN bill_m1 ELSE bill_m0 END AS open_invoice FROM dna WHERE dt = (SELECT max(dt) FROM dna) AND mix <> '0P'
 AND customer_type = 'Residencial') WHERE {AS_OF_SQL} - CAST(dt AS DATE) + overdue_age BETWEEN -3 AND 90""",
)


@query("delinquency_base", "SELECT * FROM debt")
def _(t):
    return co.delinquency_base(t.dna, AS_OF)


fragment(
    "risk",
    "SELECT account, decile, score, CASE WHEN decile <= 2 THEN 'High' WHEN decile BETWEEN 3 AND 8 THEN 'Medium' ELSE 'Low' END AS risk"
    " FROM risk_scores WHERE week = (SELECT max(week) FROM risk_scores)",
)


@query("risk_band", "SELECT * FROM risk")
def _(t):
    return co.risk_band(t.risk_scores)


fragment(
    "paid_lately",
    "SELECT account, CAST(round(sum(CAST(amount_text AS DOUBLE)), 2) AS DOUBLE) AS paid FROM payments"
    f" WHERE CAST(strptime(created_text, '%Y-%m-%d %H:%M:%S') AS DATE) >= {AS_OF_SQL} - 2 GROUP BY 1",
)


@query("recent_payments", "SELECT * FROM paid_lately")
def _(t):
    return co.recent_payments(t.payments, AS_OF)


CALLED = "strptime(replace(call_text, '.', ''), '%d/%m/%Y %I:%M:%S %p')"
VALID = "CASE " + " ".join(
    f"WHEN length(field_{i}) = 12 AND TRY_CAST(field_{i} AS BIGINT) > 0 THEN field_{i}" for i in co.DIALER_FIELDS
) + " END"
fragment(
    "dialled",
    f"SELECT {VALID} AS account, attempt_id, outcome, child_outcome, {CALLED} AS called_at FROM dialer_attempts",
)
fragment(
    "dialled_last",
    "SELECT account, lower(coalesce(outcome, child_outcome)) AS outcome, attempts, called_at FROM (SELECT *, row_number() OVER (PARTITION BY account"
    " ORDER BY called_at DESC NULLS LAST, attempt_id) AS rn, count(account) OVER (PARTITION BY account) AS attempts FROM dialled WHERE account IS NOT NULL)"
    f" WHERE rn = 1 AND date_trunc('month', called_at) = date_trunc('month', {AS_OF_SQL})",
)


@query("contact_history", "SELECT account, outcome, attempts, CAST(called_at AS DATE) AS called_on FROM dialled_last")
def _(t):
    return co.contact_history(t.dialer_attempts, AS_OF).select(
        "account", "outcome", "attempts", F.col("called_at").cast("date").alias("called_on")
    )


fragment(
    "rates",
    "SELECT account, CASE WHEN den > 0 THEN ((200 * num + den) // (2 * den)) / 100 END AS contact_rate FROM (SELECT coalesce(field_1, field_2) AS account,"
    " count(*) FILTER (child_outcome IS DISTINCT FROM 'No contesta1') AS num, count(contact_id) AS den FROM dialer_history GROUP BY 1)",
)


@query("contact_rate", "SELECT * FROM rates")
def _(t):
    return co.contact_rate(t.dialer_history)


fragment(
    "ticket_counts",
    "SELECT account, count(interaction_id) AS open_tickets FROM (SELECT account, interaction_id, first_value(status) OVER w AS last_status,"
    " first_value(start_ts) OVER w AS last_ts FROM (SELECT DISTINCT account, interaction_id, purpose, status, start_ts FROM tickets"
    " WHERE purpose IN ('TICKET', 'TRUCKROLL')) WINDOW w AS (PARTITION BY interaction_id ORDER BY start_ts DESC, status))"
    f" WHERE last_status = 'OPEN' AND CAST(last_ts AS DATE) >= {AS_OF_SQL} - 30 GROUP BY 1",
)


@query("open_tickets", "SELECT * FROM ticket_counts")
def _(t):
    return co.open_tickets(t.tickets, AS_OF)


fragment(
    "transfers",
    "SELECT campaign_account AS account, order_id AS last_order_id, order_start AS last_order_date, sales_rep_name AS last_sales_rep, channel_type AS last_channel,"
    " CASE WHEN lob_vo_count = 1 THEN network_type || '/VO' ELSE '' END || CASE WHEN lob_bb_count = 1 THEN network_type || '/BB' ELSE '' END"
    " || CASE WHEN lob_tv_count = 1 THEN network_type || '/TV' ELSE '' END AS tech_mix FROM (SELECT *, row_number() OVER (PARTITION BY campaign_account"
    " ORDER BY order_start DESC, order_id) AS rn FROM service_orders WHERE order_type = 'TRANSFER' AND order_status = 'COMPLETED'"
    " AND order_start >= DATE '2023-07-31') WHERE rn = 1",
)


def _restrictions(t):
    return t.service_orders.withColumn("account", F.col("campaign_account"))


@query("recent_restrictions", "SELECT * FROM transfers")
def _(t):
    return co.recent_restrictions(_restrictions(t), AS_OF)


fragment(
    "excluded",
    "SELECT account, lower(array_to_string(list_sort(list(DISTINCT category)), ',')) AS category FROM exclusions GROUP BY 1",
)
GROUP = (
    "CASE WHEN category LIKE '%xcluir%' OR category LIKE '%cesada%' THEN 'Exclusion' WHEN category LIKE '%hoenix%' THEN 'Phoenix'"
    " WHEN category LIKE '%candidato%' THEN 'Candidate' WHEN CAST(substring({a}, 7, 2) AS INT) BETWEEN 3 AND 9 THEN 'Control_group_1' ELSE 'Treatment_group' END"
)


@query(
    "exclusion_categories",
    f"SELECT account, category, {GROUP.format(a='account')} AS customer_group FROM excluded",
)
def _(t):
    return co.exclusion_categories(t.exclusions).withColumn("customer_group", co.customer_group())


fragment(
    "everything",
    f"""SELECT d.*, r.decile, r.score, r.risk, p.paid, h.outcome, h.attempts, c.contact_rate, k.open_tickets, e.category, e.account IS NOT NULL AS listed,
 t.last_order_id, t.last_order_date, {GROUP.format(a='d.account')} AS customer_group,
 CASE WHEN h.outcome IS NULL OR h.outcome NOT IN ('invalid', 'no dial tone') THEN 'valid_phone' ELSE 'invalid_phone' END AS check_phone,
 CASE WHEN lower(last_sales_rep) LIKE '%r%b%' AND lower(last_channel) LIKE '%ac19%' AND last_order_date >= {AS_OF_SQL} - 2 THEN 'Restablecido_auto_48hrs'
 WHEN lower(last_sales_rep) LIKE '%r%h%q%' AND lower(last_channel) NOT LIKE '%ac19%' AND last_order_date >= {AS_OF_SQL} - 2 THEN 'Restablecido_manu_48hrs'
 WHEN lower(last_sales_rep) LIKE '%d%g%' AND lower(last_channel) LIKE '%ac19%' THEN 'Restringido' ELSE 'Servicio_regular' END AS plan_change
 FROM debt d LEFT JOIN risk r ON d.account = r.account LEFT JOIN paid_lately p ON d.account = p.account LEFT JOIN dialled_last h ON d.account = h.account
 LEFT JOIN rates c ON d.account = c.account LEFT JOIN ticket_counts k ON d.account = k.account LEFT JOIN excluded e ON d.account = e.account
 LEFT JOIN transfers t ON d.account = t.account""",
)


def sources(t) -> co.Sources:
    return co.Sources(
        t.dna, t.risk_scores, t.payments, t.dialer_attempts, t.dialer_history, t.tickets, _restrictions(t), t.exclusions
    )


BASE_COLUMNS = (
    "account days_overdue overdue_amount decile score risk paid outcome attempts contact_rate open_tickets category last_order_id last_order_date"
    " customer_group check_phone plan_change"
).split()


@query("campaign_base", f"SELECT {', '.join(BASE_COLUMNS)} FROM everything")
def _(t):
    return co.campaign_base(sources(t), AS_OF).select(*BASE_COLUMNS)


SETTLED = " OR ".join(f"outcome LIKE '{p}'" for p in co.SETTLED_OUTCOMES)
fragment(
    "depurated",
    "SELECT *, CAST(CASE WHEN outcome IS NULL THEN days_overdue - 1 ELSE days_overdue END AS INT) AS overdue,"
    " CAST(CASE WHEN cycle LIKE '%A%' THEN oldest_due + 60 + INTERVAL 1 MONTH ELSE oldest_due + 60 END AS DATE) AS churn_date FROM everything"
    " WHERE paid IS NULL AND customer_name IS NOT NULL AND total_amount > 0 AND open_tickets IS NULL AND (outcome IS NULL OR NOT"
    f" ({SETTLED}))",
)


@query("depurate", "SELECT account, days_overdue, overdue, churn_date, outcome FROM depurated")
def _(t):
    return co.depurate(co.campaign_base(sources(t), AS_OF)).select("account", "days_overdue", "overdue", "churn_date", "outcome")


TRANCHE = (
    "CASE "
    + " ".join(f"WHEN days_overdue BETWEEN {low} AND {high} THEN '{label}'" for low, high, label in co.TRANCHES)
    + " END"
)
fragment("tranched", f"SELECT *, {TRANCHE} AS tranche FROM depurated")


@query("tranche", f"SELECT account, days_overdue, {TRANCHE} AS tranche FROM debt")
def _(t):
    base = co.delinquency_base(t.dna, AS_OF)
    return base.select("account", "days_overdue", co.tranche().alias("tranche"))


def _in(days) -> str:
    return "(" + ", ".join(str(x) for x in days) + ")"


LATE_HIGH = f"risk = 'High' AND days_overdue > 0 AND overdue IN {_in(co.HIGH_RISK_DAYS)}"
LATE_MEDIUM = f"risk = 'Medium' AND days_overdue > 0 AND overdue IN {_in(co.MEDIUM_RISK_DAYS)}"
fragment(
    "tiered",
    "SELECT *, CASE WHEN customer_group = 'Candidate' AND outcome IS NULL THEN 'Tier_00' WHEN customer_group = 'Phoenix' AND outcome IS NULL THEN 'Tier_01'"
    " WHEN customer_group = 'Candidate' OR customer_group = 'Phoenix' AND attempts >= 2 THEN 'Tier_02'"
    " WHEN customer_group = 'Control_group_1' AND days_overdue > 0 THEN 'Tier_03' WHEN tranche = '7. Close to churn' THEN 'Tier_04'"
    f" WHEN {LATE_HIGH} AND outcome IS NULL THEN 'Tier_05' WHEN {LATE_HIGH} THEN 'Tier_06' WHEN {LATE_MEDIUM} AND outcome IS NULL THEN 'Tier_07'"
    f" WHEN {LATE_MEDIUM} THEN 'Tier_08' WHEN days_overdue > 0 AND outcome IS NULL AND overdue NOT IN (1, 4, 5, 27, 30) AND cycle IN ('A', 'B', 'C') THEN 'Tier_09'"
    " WHEN days_overdue > 0 AND outcome IS NULL AND overdue NOT IN (1, 4, 5, 14, 17) AND cycle NOT IN ('A', 'B', 'C') THEN 'Tier_10' ELSE 'Tier_11' END AS tier FROM tranched",
)


@query("tier", "SELECT account, tranche, tier FROM tiered")
def _(t):
    return co.prioritise(co.campaign_base(sources(t), AS_OF)).select("account", "tranche", "tier")


fragment(
    "placed",
    "SELECT *, CAST(CASE WHEN customer_group IN ('Candidate', 'Phoenix') THEN row_number() OVER (PARTITION BY customer_group, check_phone ORDER BY tier,"
    " decile NULLS LAST, CAST(account AS BIGINT)) WHEN customer_group = 'Control_group_1' THEN row_number() OVER (PARTITION BY customer_group, check_phone"
    " ORDER BY contact_rate DESC NULLS LAST, CAST(account AS BIGINT)) WHEN customer_group = 'Treatment_group' THEN row_number() OVER (PARTITION BY customer_group,"
    " check_phone ORDER BY tier, decile NULLS LAST, contact_rate DESC NULLS LAST, CAST(account AS BIGINT)) END AS INT) AS rank FROM tiered",
)


@query("rank_within_group", "SELECT account, customer_group, check_phone, tier, rank FROM placed")
def _(t):
    ranked = co.rank_within_group(co.prioritise(co.campaign_base(sources(t), AS_OF)))
    return ranked.select("account", "customer_group", "check_phone", "tier", "rank")


EARLY, OTHER = "cycle IN ('A', 'B', 'C')", "cycle NOT IN ('A', 'B', 'C')"
NOTICE = "CASE " + " ".join(
    [
        "WHEN NOT listed AND days_overdue = -3 THEN 'SMS-EMAIL:Prevoverdue'",
        "WHEN NOT listed AND days_overdue = 1 THEN 'SMS-EMAIL:Restriction_warning_-4_days'",
        "WHEN NOT listed AND days_overdue = 4 OR (days_overdue BETWEEN 6 AND 22 AND plan NOT LIKE '%postmora%' AND status IN ('W', 'D'))"
        " THEN 'SMS-EMAIL:Restriction_warning_-24_hrs'",
        "WHEN NOT listed AND days_overdue = 5 THEN 'SMS-EMAIL:Restriction'",
        f"WHEN NOT listed AND (days_overdue = 27 AND {EARLY} OR days_overdue = 14 AND {OTHER}) THEN 'SMS-EMAIL:Suspension_warning_-3_days'",
        f"WHEN NOT listed AND (days_overdue = 30 AND {EARLY} OR days_overdue = 17 AND {OTHER}) THEN 'SMS-EMAIL:Suspension'",
        *[
            f"WHEN NOT listed AND customer_group = 'Treatment_group' AND risk = '{level}' AND {EARLY if early else OTHER}"
            f" AND days_overdue IN {_in(days)} THEN '{message}'"
            for level, early, days, message in co.REMINDERS
        ],
        "WHEN NOT listed AND customer_group = 'Control_group_1' AND days_overdue > 0 THEN 'SMS-EMAIL:Generic'",
    ]
) + " ELSE 'NA' END"


@query("massive_notification", f"SELECT account, {NOTICE} AS notification FROM tiered")
def _(t):
    base = co.prioritise(co.campaign_base(sources(t), AS_OF))
    return base.select("account", co.massive_notification().alias("notification"))


CAPACITY = 200
REACHABLE = "(outcome IS NULL OR outcome NOT IN ('invalid', 'no dial tone'))"
CHANNEL = "CASE " + " ".join(
    [
        f"WHEN customer_group = 'Candidate' AND rank <= 20 AND {REACHABLE} THEN 'AGENT CALL Candidate'",
        f"WHEN tier = 'Tier_03' AND rank <= {CAPACITY} * 0.1 AND {REACHABLE} THEN 'AGENT CALL'",
        f"WHEN customer_group = 'Treatment_group' AND rank <= {CAPACITY} * 0.90 AND {REACHABLE} THEN 'AGENT CALL'",
        f"WHEN customer_group = 'Treatment_group' AND rank <= {CAPACITY} AND ({REACHABLE} OR outcome NOT LIKE 'n%mero%errado%') THEN 'Whatsapp'",
        *[
            f"WHEN customer_group = 'Treatment_group' AND NOT listed AND risk = '{level}' AND days_overdue IN {_in(days)} THEN 'IVR-Robocall'"
            for level, days in co.ROBOCALL_DAYS.items()
        ],
    ]
) + " ELSE 'Silence' END"


@query("contact_channel", f"SELECT account, rank, {CHANNEL} AS contact_channel FROM placed")
def _(t):
    ranked = co.rank_within_group(co.prioritise(co.campaign_base(sources(t), AS_OF)))
    channel = co.contact_channel(AS_OF, CAPACITY, 20)
    return ranked.select("account", "rank", channel.alias("contact_channel"))


RESULT = (
    f"SELECT account, customer_group, check_phone, tier, rank, phone_1, phone_2, phone_3, email, {NOTICE} AS notification, {CHANNEL} AS contact_channel,"
    f" {AS_OF_SQL} AS run_date FROM placed"
)
fragment("campaign_result", RESULT)


@query("collections_campaign", "SELECT * FROM campaign_result")
def _(t):
    out = co.campaign(sources(t), AS_OF, agent_capacity=CAPACITY, candidate_capacity=20)
    return out.select(
        "account", "customer_group", "check_phone", "tier", "rank", *co.CONTACTS, "notification", "contact_channel", "run_date"
    )


@query(
    "collections_campaign_summary",
    "SELECT customer_group, contact_channel, notification, count(*) AS accounts FROM campaign_result GROUP BY 1, 2, 3",
)
def _(t):
    return co.campaign_summary(co.campaign(sources(t), AS_OF, agent_capacity=CAPACITY, candidate_capacity=20))


@query(
    "collections_agent_calls",
    f"SELECT account, customer_group, CAST(place AS INT) AS place FROM (SELECT account, customer_group, row_number() OVER (PARTITION BY customer_group ORDER BY tier,"
    f" decile NULLS LAST, CAST(account AS BIGINT)) AS place FROM tiered WHERE {REACHABLE}) WHERE place <= {CAPACITY} * 0.1",
)
def _(t):
    """Capacity on its own: the first places of every group, nobody else ranked."""
    base = co.prioritise(co.campaign_base(sources(t), AS_OF)).where(co.reachable())
    base = base.withColumn("number", F.col("account").cast("bigint"))
    order = [("tier", False), ("decile", False), ("number", False)]
    best = rk.top_capacity(base, ["customer_group"], order, CAPACITY, 0.1, "place", exact=2)
    return best.select("account", "customer_group", "place")
