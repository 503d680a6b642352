"""The three campaign dashboards and the credit rules between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from campanula.plans import attribution as at
from campanula.plans import dashboards as db
from campanula.registry.base import bundle_sql, fragment, products_sql, query
from campanula.registry.business import EXCLUDED

SKIPPED = ("R0J0F", "F1J1F")  # bundles that void a result
SKIP_SQL = "(new_bundle NOT IN ('R0J0F', 'F1J1F') OR new_bundle IS NULL)"
BUNDLE = bundle_sql("cable_up", "internet_up", "phone_up")
DVR = "CAST(CASE WHEN lower({c}) LIKE '%dvr%' THEN 1 ELSE 0 END AS INT)"

fragment("prices_max", "SELECT package_code, CAST(round(max(price), 2) AS DOUBLE) AS price FROM package_prices GROUP BY 1")


def priced_sql(source: str, prices: str, old_code: str) -> str:
    return (
        f"SELECT s.*, a.price + CASE WHEN lower(s.stb) LIKE '%dvr%' AND d.package_code IS NOT NULL THEN 5 ELSE 0 END AS old_price,"
        f" b.price + CASE WHEN s.new_dvr = 1 AND e.package_code IS NOT NULL THEN 5 ELSE 0 END AS new_price FROM {source} s"
        f" LEFT JOIN {prices} a ON s.{old_code} = a.package_code LEFT JOIN {prices} b ON s.new_bundle = b.package_code"
        f" LEFT JOIN listed d ON s.{old_code} = d.package_code LEFT JOIN listed e ON s.new_bundle = e.package_code"
    )


def moved_sql(source: str) -> str:
    return (
        "SELECT *, CAST(CASE WHEN new_price IS NULL THEN 0 ELSE round(new_price - old_price, 2) END AS DOUBLE) AS price_dif,"
        " CASE WHEN round(new_price - old_price, 2) > 0 THEN 'UP' WHEN round(new_price - old_price, 2) < 0 THEN 'DOWN' ELSE 'EQUAL' END AS up_down"
        f" FROM {source}"
    )


def rgu_sql(old_code: str) -> str:
    change = f"{products_sql('new_bundle')} - {products_sql(old_code)}"
    return (
        f"CAST(CASE WHEN new_bundle IS NOT NULL THEN {change} END AS INT) AS rgu_change,"
        f" CASE WHEN new_bundle IS NULL THEN NULL WHEN {change} = 0 THEN 'upsell' WHEN {change} > 0 THEN 'crossell_up' ELSE 'crossell_down' END AS rgu_category"
    )


# ---- email: every matched email against every credited order ---------------

fragment(
    "email_hits",
    f"SELECT o.account_no, max(o.order_ts) AS order_ts FROM purchase_orders o JOIN email_matched m ON o.account_no = m.account_no"
    f" WHERE {EXCLUDED} AND o.order_date - m.date_sent BETWEEN 0 AND 30 GROUP BY 1",
)
fragment(
    "email_orders",
    f"SELECT o.account_no, o.order_no, o.order_date, o.ord_typ, {BUNDLE} AS new_bundle, {DVR.format(c='stb_sc')} AS new_dvr FROM purchase_orders o"
    f" JOIN email_hits h ON o.account_no = h.account_no AND o.order_ts = h.order_ts WHERE {EXCLUDED}",
)
fragment(
    "email_pairs",
    "SELECT m.*, o.order_no, o.order_date, o.ord_typ, o.new_bundle, o.new_dvr FROM email_matched m LEFT JOIN email_orders o ON m.account_no = o.account_no",
)
fragment("email_priced", priced_sql("email_pairs", "prices_max", "from_code"))
fragment(
    "email_best",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY CASE WHEN to_code = new_bundle THEN 1 ELSE 2 END, new_price DESC NULLS LAST,"
    " CASE WHEN order_date >= date_sent THEN 1 ELSE 0 END DESC, date_sent DESC, email_id, rec_id, order_no) AS rn FROM email_priced)"
    f" WHERE rn = 1 AND {SKIP_SQL}",
)
fragment("email_moved", moved_sql("email_best"))
fragment(
    "email_flagged",
    "SELECT *, CASE WHEN order_date < date_sent THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_sent FROM email_moved",
)
fragment(
    "email_migrated",
    "SELECT *, CASE WHEN prior_to_sent = 0 THEN 1 ELSE 0 END AS migrated, CASE WHEN prior_to_sent = 0 AND order_date <= date_sent + 30 THEN 1 ELSE 0 END"
    " AS migrated_one_month FROM email_flagged",
)
fragment(
    "email_result",
    "SELECT f.account_no, email_id, rec_id, order_no, date_sent, order_date, from_code, to_code, new_bundle, old_price, new_price, price_dif, up_down,"
    " CASE WHEN up_down = 'DOWN' THEN 'A. DOWNGRADE' WHEN up_down = 'EQUAL' THEN 'B. NO PRICE INCREASE' WHEN price_dif - payment_dif < 0"
    " THEN 'C. MIG TO PLAN LOWER THAN TARGET' ELSE 'D. MIG TO TARGET' END AS price_category,"
    " CAST(CASE WHEN discount = 15 AND new_bundle = to_code THEN round(((new_price - old_price) * 12 - 15) / 12, 2) ELSE price_dif END AS DOUBLE) AS arpu_dif,"
    " CASE WHEN regime = 'control_x' THEN 'control_x' WHEN regime = 'control_j' THEN 'control_j' WHEN discount = 15 THEN 'offerfit_disc'"
    " ELSE 'offer_fit_no_disc' END AS final_group, prior_to_sent, migrated, migrated_one_month,"
    " CASE WHEN to_code <> new_bundle THEN 1 ELSE 0 END AS different_offer,"
    " CASE WHEN prior_to_sent = 0 AND discount = 15 AND new_bundle = to_code THEN 1 ELSE 0 END AS discount_applied, opened, clicked, speed_dif,"
    f" {rgu_sql('from_code')}, CASE WHEN prior_to_sent = 0 OR prior_to_sent IS NULL THEN 1 ELSE 0 END AS contacted,"
    " CASE WHEN migrated_one_month = 1 AND price_dif > 0 AND prior_to_sent = 0 THEN 1 ELSE 0 END AS converted,"
    " CASE WHEN migrated_one_month = 1 AND price_dif < 0 AND prior_to_sent = 0 THEN 1 ELSE 0 END AS converted_downgrade,"
    " CASE WHEN migrated = 1 THEN CAST(date_trunc('month', order_date) AS DATE) END AS month_migration, c.city, c.addr1, c.tenure_class"
    " FROM email_migrated f LEFT JOIN city_tenure c ON f.account_no = c.account_no",
)
EMAIL_COLUMNS = (
    "account_no email_id rec_id order_no date_sent order_date from_code to_code new_bundle old_price new_price price_dif up_down price_category arpu_dif"
    " final_group prior_to_sent migrated migrated_one_month different_offer discount_applied opened clicked speed_dif rgu_change rgu_category contacted"
    " converted converted_downgrade month_migration city addr1 tenure_class"
).split()


def email_tables(t):
    return t.email_feedback, t.email_recommendations, t.purchase_orders, t.package_prices, t.front_book


EMAIL_OPTIONS = {"since": "2024-01-01", "excluded_bundles": SKIPPED}


@query("email_performance", "SELECT * FROM email_result")
def _(t):
    return db.email_performance(*email_tables(t), snapshots=t.csr, **EMAIL_OPTIONS).select(*EMAIL_COLUMNS)


def mail_credits(t):
    return db.email_credits(db.email_outcomes(*email_tables(t), **EMAIL_OPTIONS))


# ---- outbound calls --------------------------------------------------------

fragment(
    "outbound_last_call",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY call_date DESC, call_id) AS rn FROM"
    " (SELECT CAST(cuenta AS BIGINT) AS account_no, CAST(strptime(dial_text, '%m/%d/%Y') AS DATE) AS call_date, call_id, disposition, comments"
    " FROM call_feedback WHERE dial_text <> '')) WHERE rn = 1 AND call_date >= DATE '2024-01-01'",
)
fragment(
    "outbound_touches",
    "SELECT r.account_no, r.rec_id, r.rec_date, r.pkg_cde, r.recommendedpkg, r.stb, c.call_date, c.call_id, c.disposition FROM recs r JOIN outbound_last_call c"
    " ON r.account_no = c.account_no",
)
fragment(
    "outbound_hits",
    f"SELECT o.account_no, max(o.order_ts) AS order_ts FROM purchase_orders o JOIN outbound_touches m ON o.account_no = m.account_no"
    f" WHERE {EXCLUDED} AND o.order_date - m.rec_date BETWEEN 0 AND 30 GROUP BY 1",
)
fragment(
    "outbound_pairs",
    f"SELECT m.*, o.order_no, o.order_date, o.ord_typ, o.new_bundle, o.new_dvr FROM outbound_touches m LEFT JOIN (SELECT p.account_no, p.order_no, p.order_date,"
    f" p.ord_typ, {BUNDLE} AS new_bundle, {DVR.format(c='stb_sc')} AS new_dvr FROM purchase_orders p JOIN outbound_hits h ON p.account_no = h.account_no"
    f" AND p.order_ts = h.order_ts WHERE {EXCLUDED}) o ON m.account_no = o.account_no",
)
fragment("outbound_priced", priced_sql("outbound_pairs", "prices", "pkg_cde"))
fragment(
    "outbound_best",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY CASE WHEN recommendedpkg = new_bundle THEN 1 ELSE 2 END, new_price DESC NULLS LAST,"
    " CASE WHEN call_date >= rec_date THEN 1 ELSE 0 END DESC, CASE WHEN order_date >= call_date THEN 1 ELSE 0 END DESC, rec_date DESC, rec_id, order_no) AS rn"
    f" FROM outbound_priced) WHERE rn = 1 AND {SKIP_SQL}",
)
fragment("outbound_moved", moved_sql("outbound_best"))
fragment(
    "outbound_flagged",
    "SELECT *, CASE WHEN order_date < rec_date THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_sent,"
    " CASE WHEN order_date < call_date THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_call,"
    " CASE WHEN call_date <= order_date THEN 1 ELSE 0 END AS call_before_migration FROM outbound_moved",
)
fragment(
    "outbound_migrated",
    "SELECT *, CASE WHEN prior_to_sent = 0 AND prior_to_call = 0 AND call_before_migration = 1 THEN 1 ELSE 0 END AS migrated,"
    " CASE WHEN prior_to_sent = 0 AND rec_date <= call_date AND order_date <= rec_date + 30 AND call_date <= order_date THEN 1 ELSE 0 END AS migrated_one_month"
    " FROM outbound_flagged",
)
fragment(
    "email_won",
    "SELECT account_no, date_sent AS mail_sent, month_migration AS mail_month FROM email_result WHERE migrated_one_month = 1",
)
fragment(
    "outbound_joined",
    "SELECT f.*, c.city, c.addr1, c.tenure_class, m.mail_month, CASE WHEN migrated_one_month = 1 THEN CAST(date_trunc('month', order_date) AS DATE) END AS outbound_month"
    " FROM outbound_migrated f LEFT JOIN city_tenure c ON f.account_no = c.account_no LEFT JOIN email_won m ON f.account_no = m.account_no",
)
fragment(
    "outbound_excluded",
    "SELECT *, CASE WHEN mail_month >= outbound_month THEN 1 ELSE 0 END AS exclude_mail, CASE WHEN mail_month < outbound_month THEN 1 ELSE 0 END AS previous_mail"
    " FROM outbound_joined",
)
fragment(
    "outbound_result",
    "SELECT account_no, rec_id, call_id, order_no, rec_date, call_date, order_date, pkg_cde, recommendedpkg, new_bundle, old_price, new_price, price_dif, up_down,"
    " prior_to_sent, prior_to_call, call_before_migration, migrated, migrated_one_month, disposition, exclude_mail, previous_mail, outbound_month,"
    f" {rgu_sql('pkg_cde')}, CASE WHEN (prior_to_sent = 0 OR prior_to_sent IS NULL) AND rec_date <= call_date"
    " AND regexp_matches(lower(disposition), 'ofiti.+cliente.+acepta') THEN 1 ELSE 0 END AS contacted,"
    " CASE WHEN migrated_one_month = 1 AND exclude_mail = 0 AND price_dif > 0 AND regexp_matches(lower(disposition), 'ofiti.+cliente.acepta') THEN 1 ELSE 0 END AS converted,"
    " CASE WHEN migrated_one_month = 1 AND exclude_mail = 0 AND price_dif < 0 AND regexp_matches(lower(disposition), 'ofiti.+cliente.acepta') THEN 1 ELSE 0 END"
    " AS converted_downgrade, ' ' AS email_id, 'Offerfit' AS final_group, city, addr1, tenure_class FROM outbound_excluded",
)
OUTBOUND_COLUMNS = (
    "account_no rec_id call_id order_no rec_date call_date order_date pkg_cde recommendedpkg new_bundle old_price new_price price_dif up_down prior_to_sent"
    " prior_to_call call_before_migration migrated migrated_one_month disposition exclude_mail previous_mail outbound_month rgu_change rgu_category"
    " contacted converted converted_downgrade email_id final_group city addr1 tenure_class"
).split()


def outbound_tables(t, mail):
    return t.recommendations, t.call_feedback, t.purchase_orders, t.package_prices, t.front_book, mail


OUTBOUND_OPTIONS = {"since": "2024-01-01", "until": "2024-01-31", "excluded_bundles": SKIPPED}


@query("outbound_performance", "SELECT * FROM outbound_result")
def _(t):
    out = db.outbound_performance(*outbound_tables(t, mail_credits(t)), snapshots=t.csr, **OUTBOUND_OPTIONS)
    return out.select(*OUTBOUND_COLUMNS)


# ---- inbound calls ---------------------------------------------------------

HALVES = (("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-31"))
AREAS = at.INBOUND_AREAS


def inbound_month_sql(start: str, end: str) -> str:
    """One period, every answered recommendation against every order of its account."""
    return (
        f"WITH r AS (SELECT *, CAST(substring(date_text, 1, 10) AS DATE) AS rec_date FROM recommendations WHERE date_text <> '0'"
        f" AND substring(date_text, 1, 10) BETWEEN '{start}' AND '{end}'),"
        f" calls AS (SELECT account_no, start_date AS call_date FROM interactions WHERE regexp_matches(lower(channel), '{AREAS}')"
        f" AND regexp_matches(lower(info), 'phone|contact.+center') AND start_date BETWEEN DATE '{start}' AND DATE '{end}'),"
        " spans AS (SELECT account_no, min(call_date) AS first_call, max(call_date) AS last_call FROM calls GROUP BY 1),"
        " joined AS (SELECT r.*, c.call_date, s.first_call, s.last_call FROM r JOIN calls c ON r.account_no = c.account_no"
        " AND c.call_date BETWEEN r.rec_date AND r.rec_date + 30 JOIN spans s ON r.account_no = s.account_no),"
        f" named AS (SELECT *, {BUNDLE} AS new_bundle, {DVR.format(c='stb_sc')} AS new_dvr FROM purchase_orders WHERE {EXCLUDED}"
        f" AND order_date BETWEEN DATE '{start}' AND DATE '{end}' AND regexp_matches(lower(salesrep_area), '{AREAS}')),"
        " latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY order_ts DESC, order_no) AS rn FROM named WHERE new_bundle IS NOT NULL) WHERE rn = 1),"
        " pairs AS (SELECT j.*, o.order_no, o.order_date, o.new_bundle, o.new_dvr, CAST(o.order_date - j.rec_date AS INT) AS days_to_order"
        " FROM joined j LEFT JOIN latest o ON j.account_no = o.account_no),"
        " best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY CASE WHEN days_to_order >= 0 THEN 1 ELSE 0 END DESC,"
        " days_to_order NULLS LAST, rec_date DESC, call_date DESC, rec_id) AS rn FROM pairs) WHERE rn = 1),"
        f" priced AS ({priced_sql('best', 'prices', 'pkg_cde')}), moved AS ({moved_sql('priced')}),"
        " flagged AS (SELECT *, CASE WHEN order_date < rec_date THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_sent,"
        " CASE WHEN order_date < first_call THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_call,"
        " CASE WHEN rec_date <= last_call THEN 1 ELSE 0 END AS call_after_rec FROM moved)"
        " SELECT f.account_no, rec_id, order_no, rec_date, call_date, first_call, last_call, order_date, days_to_order, pkg_cde, recommendedpkg, new_bundle,"
        " old_price, new_price, price_dif, up_down, prior_to_sent, prior_to_call, call_after_rec,"
        " CASE WHEN prior_to_sent = 0 AND prior_to_call = 0 AND call_after_rec = 1 THEN 1 ELSE 0 END AS migrated,"
        " CASE WHEN prior_to_sent = 0 AND rec_date <= last_call AND order_date <= rec_date + 30 AND first_call <= order_date THEN 1 ELSE 0 END AS migrated_one_month,"
        " CASE WHEN recommendedpkg = new_bundle THEN 1 ELSE 0 END AS accepted_recommendation,"
        f" {rgu_sql('pkg_cde')}, CAST(date_trunc('month', rec_date) AS DATE) AS rec_month,"
        " CASE WHEN substring(CAST(f.account_no AS VARCHAR), 15, 2) IN ('24','99','67','41','19') THEN 'control_A'"
        " WHEN substring(CAST(f.account_no AS VARCHAR), 15, 2) IN ('25','47','79','22','93') THEN 'control_X' ELSE 'offerfit' END AS group_type,"
        " c.city, c.addr1, c.tenure_class FROM flagged f LEFT JOIN city_tenure c ON f.account_no = c.account_no"
    )


INBOUND_COLUMNS = (
    "account_no rec_id order_no rec_date call_date first_call last_call order_date days_to_order pkg_cde recommendedpkg new_bundle old_price new_price"
    " price_dif up_down prior_to_sent prior_to_call call_after_rec migrated migrated_one_month accepted_recommendation rgu_change rgu_category rec_month"
    " group_type city addr1 tenure_class"
).split()
fragment("inbound_a", inbound_month_sql(*HALVES[0]))
fragment("inbound_b", inbound_month_sql(*HALVES[1]))


INBOUND_OWN = [c for c in INBOUND_COLUMNS if c not in ("city", "addr1", "tenure_class")]


def inbound_tables(t):
    return t.recommendations, t.interactions, t.purchase_orders, t.package_prices, t.front_book


@query("inbound_month", "SELECT * FROM inbound_b")
def _(t):
    start, end = HALVES[1]
    return at.enrich_city_tenure(db.inbound_month(*inbound_tables(t), start=start, end=end).select(*INBOUND_OWN), t.csr)


@query(
    "inbound_periods",
    f"SELECT 0 AS period, {', '.join(INBOUND_OWN)} FROM inbound_a UNION ALL SELECT 1, {', '.join(INBOUND_OWN)} FROM inbound_b",
)
def _(t):
    return db.inbound_periods(*inbound_tables(t), periods=HALVES).select("period", *INBOUND_OWN)


fragment(
    "outbound_won",
    "SELECT account_no, rec_date AS outbound_rec, outbound_month FROM outbound_result WHERE migrated_one_month = 1 AND exclude_mail = 0"
    " AND call_before_migration = 1 AND regexp_matches(lower(disposition), 'ofiti.+cliente.acepta')",
)
fragment(
    "inbound_one",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY prior_to_sent NULLS LAST, prior_to_call NULLS LAST, call_after_rec DESC,"
    " migrated DESC, rec_date DESC, rec_id) AS rn FROM (SELECT * FROM inbound_a UNION ALL BY NAME SELECT * FROM inbound_b)) WHERE rn = 1",
)
fragment(
    "inbound_excluded",
    "SELECT a.*, CASE WHEN mail_month >= rec_month THEN 1 ELSE 0 END AS exclude_mail, CASE WHEN mail_month < rec_month THEN 1 ELSE 0 END AS previous_mail,"
    " CASE WHEN outbound_month >= rec_month THEN 1 ELSE 0 END AS exclude_outbound FROM inbound_one a LEFT JOIN email_won b ON a.account_no = b.account_no"
    " LEFT JOIN outbound_won c ON a.account_no = c.account_no",
)
CLEAN = (
    "(prior_to_sent = 0 OR prior_to_sent IS NULL) AND (prior_to_call = 0 OR prior_to_call IS NULL) AND exclude_mail = 0 AND exclude_outbound = 0"
)
fragment(
    "inbound_result",
    f"SELECT *, CASE WHEN call_date IS NOT NULL AND {CLEAN} THEN 1 ELSE 0 END AS contacted,"
    f" CASE WHEN migrated = 1 AND price_dif > 0 AND call_after_rec = 1 AND {CLEAN} THEN 1 ELSE 0 END AS converted,"
    f" CASE WHEN migrated = 1 AND price_dif < 0 AND call_after_rec = 1 AND {CLEAN} THEN 1 ELSE 0 END AS converted_downgrade, ' ' AS email_id FROM inbound_excluded",
)


@query("inbound_performance", "SELECT * FROM inbound_result")
def _(t):
    mail = mail_credits(t)
    outbound = db.outbound_credits(db.outbound_outcomes(*outbound_tables(t, mail), **OUTBOUND_OPTIONS))
    inbound = db.inbound_periods(*inbound_tables(t), periods=HALVES).select("period", *INBOUND_OWN)
    out = db.inbound_performance(inbound, mail, outbound, t.csr)
    return out.drop("mail_sent", "mail_month", "outbound_rec", "outbound_month")


# ---- credit between channels, on its own ------------------------------------

SPLIT = "CASE order_no % 3 WHEN 0 THEN 'mail' WHEN 1 THEN 'outbound' ELSE 'inbound' END"
fragment(
    "channel_months",
    f"SELECT account_no, {SPLIT} AS channel, max(CAST(date_trunc('month', order_date) AS DATE)) AS month FROM orders_activity GROUP BY 1, 2",
)
fragment(
    "credited",
    "SELECT i.account_no, i.month AS rec_month, CASE WHEN m.month >= i.month THEN 1 ELSE 0 END AS exclude_mail, CASE WHEN m.month < i.month THEN 1 ELSE 0 END"
    " AS previous_mail, CASE WHEN o.month >= i.month THEN 1 ELSE 0 END AS exclude_outbound FROM channel_months i"
    " LEFT JOIN channel_months m ON i.account_no = m.account_no AND m.channel = 'mail'"
    " LEFT JOIN channel_months o ON i.account_no = o.account_no AND o.channel = 'outbound' WHERE i.channel = 'inbound'",
)


def _credited(t):
    place = F.col("order_no") % 3
    channel = F.when(place == 0, "mail").when(place == 1, "outbound").otherwise("inbound")
    months = t.orders_activity.groupBy("account_no", channel.alias("channel")).agg(
        F.max(F.trunc("order_date", "MM")).alias("month")
    )

    def only(name, column):
        return months.where(F.col("channel") == name).select("account_no", F.col("month").alias(column))

    return db.cross_channel_exclusion(only("inbound", "rec_month"), only("mail", "mail_month"), only("outbound", "outbound_month"))


@query("cross_channel_exclusion", "SELECT * FROM credited")
def _(t):
    return _credited(t).drop("mail_month", "outbound_month")


@query(
    "conversion_outcome",
    "WITH s AS (SELECT c.*, CASE WHEN account_no % 4 = 0 THEN NULL ELSE CAST(account_no % 2 AS INT) END AS prior_to_sent, CAST(CASE WHEN account_no % 3 = 0 THEN 1 ELSE 0 END AS INT)"
    " AS prior_to_call, CAST(CASE WHEN account_no % 5 = 0 THEN 0 ELSE 1 END AS INT) AS migrated,"
    " CAST(CASE WHEN account_no % 11 < 2 THEN 0 ELSE 1 END AS INT) AS call_after_rec, CASE WHEN account_no % 13 <> 0 THEN rec_month END AS call_date, CAST(account_no % 7 - 3 AS DOUBLE) AS price_dif FROM credited c)"
    f" SELECT account_no, CASE WHEN call_date IS NOT NULL AND {CLEAN} THEN 1 ELSE 0 END AS contacted,"
    f" CASE WHEN migrated = 1 AND price_dif > 0 AND call_after_rec = 1 AND {CLEAN} THEN 1 ELSE 0 END AS converted,"
    f" CASE WHEN migrated = 1 AND price_dif < 0 AND call_after_rec = 1 AND {CLEAN} THEN 1 ELSE 0 END AS converted_downgrade FROM s",
)
def _(t):
    account = F.col("account_no")
    states = _credited(t).withColumns(
        {
            "prior_to_sent": F.when(account % 4 != 0, (account % 2).cast("int")),
            "prior_to_call": F.when(account % 3 == 0, 1).otherwise(0),
            "migrated": F.when(account % 5 == 0, 0).otherwise(1),
            "call_after_rec": F.when(account % 11 < 2, 0).otherwise(1),
            "call_date": F.when(account % 13 != 0, F.col("rec_month")),
            "price_dif": (account % 7 - 3).cast("double"),
        }
    )
    return db.conversion_outcome(states).select("account_no", "contacted", "converted", "converted_downgrade")
