"""Business operators one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from campanula.operators import snapshot as sn
from campanula.plans import attribution as at
from campanula.plans import audiences as au
from campanula.plans import conversion as cv
from campanula.plans import customers as cu
from campanula.plans import offers as of
from campanula.plans import pricing as pr
from campanula.registry.base import AS_OF, AS_OF_SQL, bundle_sql, day_of, fragment, products_sql, query, x_sql

# ---- customers -------------------------------------------------------------

SUFFIX = "substring(CAST(account_no AS VARCHAR), length(CAST(account_no AS VARCHAR)) - 1, 2)"
CONTROL_SQL = (
    f"CASE WHEN {SUFFIX} IN ('24','99','67','41','19') THEN 'Control A' WHEN {SUFFIX} IN ('25','47','79','22','93') THEN 'Control X'"
    f" WHEN {SUFFIX} IN ('26','48','80','23','94') THEN 'Control J' ELSE 'Target' END"
)

fragment(
    "customers",
    f"SELECT account_no, as_of, {x_sql('welcome_offer')} AS welcome_offer, {x_sql('acp')} AS subsidized, {x_sql('joint_customer')} AS joint_customer,"
    " bill_code[1] IN ('R','F') AND bill_code[2] IN ('1','2','3','4','5','6','7') AS valid_package,"
    f" {CONTROL_SQL} AS regime, addr1 AS address, home_phone AS phone_1, bus_phone AS phone_2, cycle_day AS invoice_day, email, customer_type,"
    " delinquency_days, hsd, bill_code AS package_code, res_name AS customer_name,"
    " substring(res_name, position(',' IN res_name) + 1) AS first_name,"
    " CASE WHEN position(',' IN res_name) > 0 THEN substring(res_name, 1, position(',' IN res_name) - 1) ELSE '' END AS last_name, tenure FROM latest_csr",
)


@query("csr_attributes", "SELECT * FROM customers")
def _(t):
    return cu.csr_attributes(t.csr)


@query(
    "csr_attributes_shifted",
    "SELECT account_no, CAST(CASE WHEN delinquency_days = 0 THEN 0 WHEN delinquency_days > 0 THEN delinquency_days + 2 END AS INT) AS delinquency_days FROM customers",
)
def _(t):
    return cu.csr_attributes(t.csr, shift_days=2).select("account_no", "delinquency_days")


@query("control_group", f"SELECT account_no, {CONTROL_SQL} AS regime FROM customer_profile")
def _(t):
    return t.customer_profile.select("account_no", cu.control_group("account_no").alias("regime"))


@query(
    "control_group_digits",
    "SELECT account, dt, CAST(substring(account, 7, 2) AS INT) BETWEEN 3 AND 9 AS control FROM dna",
)
def _(t):
    return t.dna.select("account", "dt", cu.control_group_digits("account").alias("control"))


fragment(
    "flagged",
    f"SELECT account_no, {x_sql('has_privacy_flag')} AS privacy_flag, {x_sql('has_open_order')} AS open_order,"
    f" {x_sql('pending_tc')} AS trouble_call, {x_sql('is_in_ndnc')} AS do_not_call FROM account_flags",
)


@query("account_flags", "SELECT * FROM flagged")
def _(t):
    return cu.account_flags(t.account_flags)


fragment("phone_counts", "SELECT home_phone, count(DISTINCT account_no) AS num_accounts FROM latest_csr GROUP BY 1")


@query(
    "customer_features",
    "SELECT 'ACCT_FX_' || CAST(a.account_no AS VARCHAR) AS account_id, a.account_no, a.home_phone, b.num_accounts,"
    " epoch_ms(CAST(CASE WHEN cycle_day > 10 THEN DATE '2024-02-01' + least(cycle_day, 29) - 1 ELSE DATE '2024-03-01' + cycle_day - 1 END AS TIMESTAMP)) AS last_bill_ms,"
    " d.changed_speed, epoch_ms(CAST(a.as_of AS TIMESTAMP)) AS dt_ms FROM latest_csr a"
    " LEFT JOIN phone_counts b ON a.home_phone IS NOT DISTINCT FROM b.home_phone"
    " LEFT JOIN (SELECT account_no, count(DISTINCT hsd_speed) > 1 AS changed_speed FROM csr GROUP BY 1) d ON a.account_no = d.account_no",
)
def _(t):
    return cu.customer_features(t.csr, "2024-03-10")


fragment(
    "last_comms",
    "SELECT account_no, max(CASE WHEN channel = 'email' THEN sent_ms END) AS last_email_sent_ms, max(CASE WHEN channel = 'email' THEN contact_ms END)"
    " AS last_email_contact_ms, max(CASE WHEN channel = 'email' THEN conv_ms END) AS last_email_conv_ms,"
    " max(CASE WHEN channel = 'outbound_call' THEN sent_ms END) AS last_call_sent_ms,"
    " max(CASE WHEN channel = 'outbound_call' THEN contact_ms END) AS last_call_contact_ms FROM comms_history GROUP BY 1",
)


@query("last_contacts", "SELECT * FROM last_comms")
def _(t):
    return cu.last_contacts(t.comms_history)


RECENCY = (
    "SELECT account_no, coalesce({s} >= {a} - 42, false) AS call_sent_42d, coalesce({c} >= DATE '{m}' AND {s} >= DATE '{m}', false) AS call_contacted_months,"
    " coalesce({e} >= {a} - 21, false) AS email_sent_21d FROM last_comms"
)


def recency_sql(as_of_sql: str, months_ago: str) -> str:
    return RECENCY.format(
        s=day_of("last_call_sent_ms"), c=day_of("last_call_contact_ms"), e=day_of("last_email_sent_ms"), a=as_of_sql, m=months_ago
    )


@query("recency_flags", recency_sql("DATE '2024-02-29'", "2024-01-31"))
def _(t):
    # the last day of February minus a month is the last day of January
    return au.recency_flags(cu.last_contacts(t.comms_history), "2024-02-29", 1)


@query(
    "migration_recency",
    "SELECT DISTINCT account_no FROM orders_activity WHERE lower(ord_typ) IN ('upgrade','downgrade','sidegrade') AND order_date >= DATE '2023-07-31'",
)
def _(t):
    return au.migration_recency(t.orders_activity, AS_OF, 6)


# ---- offers ----------------------------------------------------------------


def _email(c: str) -> str:
    return f"max(CASE WHEN lower(channel) = 'email' THEN {c} END)"


ATTRIBUTES = {
    "from_package": "max(pkg_cde)",
    "email_from_speed": _email("hsd_service"),
    "email_to_package": _email("recommendedpkg"),
    "email_to_speed": _email("to_speed_name"),
    "email_discount": _email("discount"),
    "single_recommended_ms": "max(CASE WHEN lower(offer_type) = 'single' THEN recommended_ms END)",
    "multiple_recommended_ms": "max(CASE WHEN lower(offer_type) = 'multiple' THEN recommended_ms END)",
    "email_stb": _email("stb"),
    "email_pay_difference": _email("delta_arpu"),
    "regime": "max(regime)",
    "email_next_action_ms": _email("next_best_action_ms"),
    "email_time_frame": _email("time_frame"),
    "email_template": _email("param_1"),
    "email_message": _email("param_2"),
    "email_call_to_action": _email("param_3"),
    "email_subject": _email("param_4"),
    "email_link": _email("link"),
    "email_link_expiry_ms": _email("link_exp_ms"),
    "email_link_ms": _email("link_ms"),
}
fragment(
    "offer_facts",
    "SELECT account_no, " + ", ".join(f"{e} AS {n}" for n, e in ATTRIBUTES.items()) + " FROM offers GROUP BY 1",
)


@query("offer_attributes", "SELECT * FROM offer_facts")
def _(t):
    return of.offer_attributes(t.offers)


FACT_CHECKS = {
    "email_call_to_action": "lower(email_call_to_action) LIKE '%si deseas el%'",
    "email_discount": "email_discount >= 0",
    "email_next_best_action": "email_next_action_ms IS NOT NULL",
    "email_pay_difference": "email_pay_difference > 0",
    "email_stb_code": "email_stb IS NOT NULL",
    "email_time_frame": "lower(email_time_frame) LIKE 'afternoon'",
    "email_to_speed": "email_to_speed IS NOT NULL",
    "email_stb_blank": "email_stb = ' ' OR email_stb IS NULL",
    "email_from_speed": "email_from_speed IS NOT NULL",
    "from_package": "from_package IS NOT NULL",
    "message_subject": "lower(email_subject) LIKE '%velocidad%'",
    "multiple_recommended": "multiple_recommended_ms IS NOT NULL",
    "single_recommended": "single_recommended_ms IS NOT NULL",
    "offer_regime": "lower(regime) LIKE '%control%'",
    "email_message_text": "email_message IS NOT NULL",
    "email_template_type": "email_template = '1'",
}
ROW_CHECKS = {
    "offer_channel": "lower(channel) LIKE '%call%center%'",
    "offer_type": "lower(offer_type) LIKE '%single%'",
    "rank_order": "offer_rank = 1",
    "reward": "reward > 0.5",
}


def _count_query(check: str, table: str, condition: str) -> None:
    sql = (
        f"SELECT count(DISTINCT c.account_no) AS accounts FROM latest_csr c LEFT JOIN {table} o ON c.account_no = o.account_no WHERE {condition}"
    )

    @query(f"offer_attribute_count_{check}", sql)
    def _(t):
        return of.offer_attribute_count(sn.latest_snapshot(t.csr, "as_of"), t.offers, check)


for _check, _condition in FACT_CHECKS.items():
    _count_query(_check, "offer_facts", _condition)
for _check, _condition in ROW_CHECKS.items():
    _count_query(_check, "offers", _condition)


# all checks in one query: one pass over the offers, one join
@query(
    "offer_attribute_count",
    " UNION ALL ".join(
        f"SELECT '{check}' AS attribute, count(DISTINCT c.account_no) AS accounts FROM latest_csr c LEFT JOIN {table} o"
        f" ON c.account_no = o.account_no WHERE {condition}"
        for table, checks in (("offer_facts", FACT_CHECKS), ("offers", ROW_CHECKS))
        for check, condition in checks.items()
    ),
)
def _(t):
    return of.offer_attribute_counts(sn.latest_snapshot(t.csr, "as_of"), t.offers)


@query(
    "offer_attribute_count_converted_3_month",
    "SELECT count(DISTINCT c.account_no) AS accounts FROM latest_csr c JOIN orders_activity o ON c.account_no = o.account_no"
    " WHERE lower(ord_typ) IN ('upgrade','downgrade','sidegrade') AND order_date >= DATE '2023-10-31'",
)
def _(t):
    base = sn.latest_snapshot(t.csr, "as_of").select("account_no")
    return au.size(base.join(au.migration_recency(t.orders_activity, AS_OF, 3), "account_no", "left_semi"))


@query(
    "offer_attribute_count_target",
    "SELECT count(DISTINCT c.account_no) AS accounts FROM latest_csr c LEFT JOIN offers o ON c.account_no = o.account_no WHERE o.regime = 'offerfit'",
)
def _(t):
    base = sn.latest_snapshot(t.csr, "as_of").select("account_no")
    return au.size(base.join(t.offers.where(F.col("regime") == au.TARGET_REGIME), "account_no", "left_semi"))


@query(
    "bau_offer",
    "WITH p AS (SELECT *, CASE WHEN drop_type = 'COAX' THEN 'Coax Trad' ELSE 'FTTH' END AS kind, substring(play_type, 1, 2) AS play_kind,"
    " CASE video_service WHEN 'BASIC' THEN 'Basic' WHEN 'CHOICE PACK' THEN 'Choice Pack' WHEN 'ESP PRIMERA' THEN 'EDP' WHEN 'ULTIMATE' THEN 'Ultimate'"
    " WHEN 'UPICK' THEN 'UPICK' END AS tv_kind,"
    " play_type IN ('3P Video HSD Voice', '2P HSD Voice', '2P Video HSD ', '1P HSD ') AS net,"
    " play_type IN ('3P Video HSD Voice', '2P Video Voice', '2P Video HSD ', '1P Video ') AS vid,"
    " play_type IN ('3P Video HSD Voice', '2P HSD Voice', '2P Video Voice', '1P Voice') AS voice FROM customer_profile),"
    " ranked AS (SELECT p.account_no, p.kind AS drop_kind, p.package_code AS package_from, p.total_charge AS price_from, p.down_speed AS speed_from,"
    " f.package_code AS package_to, f.price AS price_to, f.speed AS speed_to, f.price - p.total_charge AS delta_price,"
    " row_number() OVER (PARTITION BY p.account_no ORDER BY f.price, f.speed DESC, f.package_code) AS ranking FROM p JOIN front_book f"
    " ON kind = f.connection AND play_kind = f.play AND tv_kind = f.tv AND f.speed >= p.down_speed AND net = (f.modem IS NOT NULL)"
    " AND vid = (f.tv IS NOT NULL) AND voice = (f.phone IS NOT NULL)"
    " AND CASE WHEN lower(stb_sc) LIKE '%dvr%' THEN f.price + 5 > p.total_charge ELSE f.price > p.total_charge END)"
    " SELECT * EXCLUDE (ranking) FROM ranked WHERE ranking = 1",
)
def _(t):
    return of.bau_offer(t.customer_profile, t.front_book)


# ---- bundles and prices ----------------------------------------------------


@query(
    "resolve_bundle",
    f"SELECT order_no, {bundle_sql('cable_up', 'internet_up', 'phone_up')} AS new_bundle FROM orders_activity",
)
def _(t):
    return t.orders_activity.select("order_no", pr.bundle_up().alias("new_bundle"))


@query(
    "resolve_bundle_by_direction",
    "SELECT order_no, CASE WHEN ord_typ <> 'DOWNGRADE' THEN "
    + bundle_sql("cable_up", "internet_up", "phone_up")
    + " ELSE "
    + bundle_sql("cable_down", "internet_down", "phone_down")
    + " END AS new_bundle FROM orders_activity",
)
def _(t):
    return t.orders_activity.select("order_no", pr.bundle_by_direction().alias("new_bundle"))


@query("dvr_flag", "SELECT order_no, CASE WHEN lower(stb_sc) LIKE '%dvr%' THEN 1 ELSE 0 END AS dvr FROM orders_activity")
def _(t):
    return t.orders_activity.select("order_no", pr.has_dvr("stb_sc").alias("dvr"))


def _panel(how: str, sql: str, name: str) -> None:
    @query(
        name,
        f"SELECT package_code, CAST(round({sql}(price), 2) AS DOUBLE) AS price, min(description) AS description FROM package_prices GROUP BY 1",
    )
    def _(t):
        return pr.package_price_panel(t.package_prices, how)


_panel("any", "min", "package_price_panel")
_panel("min", "min", "package_price_panel_min")
_panel("max", "max", "package_price_panel_max")


@query("asset_price", "SELECT * FROM asset_prices")
def _(t):
    return pr.asset_price(t.assets)


fragment("listed", "SELECT DISTINCT package_code FROM front_book")
fragment(
    "repriced",
    f"SELECT o.order_no, o.pkg AS from_code, o.new_bundle, o.old_dvr, o.new_dvr, o.order_no % 40 AS promised, o.discount, o.target,"
    " CASE WHEN d.package_code IS NULL THEN 0 ELSE 1 END AS old_listed, CASE WHEN e.package_code IS NULL THEN 0 ELSE 1 END AS new_listed,"
    " a.price + CASE WHEN o.old_dvr = 1 AND d.package_code IS NOT NULL THEN 5 ELSE 0 END AS old_price,"
    " b.price + CASE WHEN o.new_dvr = 1 AND e.package_code IS NOT NULL THEN 5 ELSE 0 END AS new_price FROM (SELECT order_no,"
    f" cable_down AS pkg, {bundle_sql('cable_up', 'internet_up', 'phone_up')} AS new_bundle, CAST(CASE WHEN order_no % 3 = 0 THEN 1 ELSE 0 END AS INT) AS old_dvr,"
    " CAST(CASE WHEN lower(stb_sc) LIKE '%dvr%' THEN 1 ELSE 0 END AS INT) AS new_dvr, CASE WHEN order_no % 2 = 0 THEN 15 ELSE 0 END AS discount,"
    " substring(internet_up, 1, 5) AS target FROM orders_activity) o LEFT JOIN prices a ON o.pkg = a.package_code LEFT JOIN prices b"
    " ON o.new_bundle = b.package_code LEFT JOIN listed d ON o.pkg = d.package_code LEFT JOIN listed e ON o.new_bundle = e.package_code",
)


def _coded_orders(t):
    return t.orders_activity.select(
        "order_no",
        F.col("cable_down").alias("from_code"),
        pr.bundle_up().alias("new_bundle"),
        F.when(F.col("order_no") % 3 == 0, 1).otherwise(0).alias("old_dvr"),
        pr.has_dvr("stb_sc").alias("new_dvr"),
        (F.col("order_no") % 40).alias("promised"),
        F.when(F.col("order_no") % 2 == 0, 15).otherwise(0).alias("discount"),
        F.substring("internet_up", 1, 5).alias("target"),
    )


def _repriced(t):
    return pr.old_new_price(
        _coded_orders(t), pr.package_price_panel(t.package_prices), t.front_book, old_code="from_code", new_code="new_bundle"
    )


@query(
    "old_new_price",
    "SELECT order_no, from_code, new_bundle, old_listed, new_listed, old_price, new_price FROM repriced",
)
def _(t):
    return _repriced(t).select("order_no", "from_code", "new_bundle", "old_listed", "new_listed", "old_price", "new_price")


fragment(
    "price_moves",
    "SELECT *, CASE WHEN new_price IS NULL THEN 0 ELSE round(new_price - old_price, 2) END AS price_dif,"
    " CASE WHEN round(new_price - old_price, 2) > 0 THEN 'UP' WHEN round(new_price - old_price, 2) < 0 THEN 'DOWN' ELSE 'EQUAL' END AS up_down FROM repriced",
)


@query(
    "price_delta",
    "SELECT order_no, price_dif, up_down, CASE WHEN price_dif > 0 THEN 1 ELSE 0 END AS positive_price_dif, CASE WHEN price_dif < 0 THEN 1 ELSE 0 END"
    " AS negative_price_dif, CASE WHEN up_down = 'DOWN' THEN 'A. DOWNGRADE' WHEN up_down = 'EQUAL' THEN 'B. NO PRICE INCREASE'"
    " WHEN price_dif - promised < 0 THEN 'C. MIG TO PLAN LOWER THAN TARGET' ELSE 'D. MIG TO TARGET' END AS price_category FROM price_moves",
)
def _(t):
    return pr.price_delta(_repriced(t), promised="promised").select(
        "order_no", "price_dif", "up_down", "positive_price_dif", "negative_price_dif", "price_category"
    )


@query(
    "delta_arpu_adjusted",
    "SELECT order_no, CAST(round(b.price + CASE WHEN new_dvr = 1 THEN 5 ELSE 0 END, 2) AS DOUBLE) AS new_price_dvr,"
    " CAST(round(b.price + CASE WHEN new_dvr = 1 THEN 5 ELSE 0 END - CASE WHEN new_bundle = target AND discount = 15 THEN 1.25 ELSE 0 END - a.price, 2) AS DOUBLE)"
    " AS delta_arpu FROM repriced r LEFT JOIN asset_prices a ON r.from_code = a.package_code LEFT JOIN asset_prices b ON r.new_bundle = b.package_code",
)
def _(t):
    from campanula.operators.joining import role_join

    priced = role_join(_coded_orders(t), pr.asset_price(t.assets), "package_code", {"old": "from_code", "new": "new_bundle"})
    return pr.delta_arpu_adjusted(priced, new_code="new_bundle", target_code="target", discount="discount").select(
        "order_no", "new_price_dvr", "delta_arpu"
    )


@query(
    "rgu_category",
    f"SELECT order_no, CAST({products_sql('new_bundle')} - {products_sql('from_code')} AS INT) AS rgu_change,"
    f" CASE WHEN new_bundle IS NULL THEN NULL WHEN {products_sql('new_bundle')} = {products_sql('from_code')} THEN 'upsell'"
    f" WHEN {products_sql('new_bundle')} > {products_sql('from_code')} THEN 'crossell_up' ELSE 'crossell_down' END AS rgu_category"
    " FROM repriced WHERE new_bundle IS NOT NULL",
)
def _(t):
    return (
        _repriced(t)
        .where(F.col("new_bundle").isNotNull())
        .select(
            "order_no",
            at.rgu_change("from_code", "new_bundle").alias("rgu_change"),
            at.rgu_category("from_code", "new_bundle").alias("rgu_category"),
        )
    )


# ---- attribution -----------------------------------------------------------

EXCLUDED = "ord_typ NOT IN ('CONNECT', 'V_DISCO', 'NON PAY', 'RESTART')"
fragment(
    "sparse_touches",
    "SELECT account_no, comm_date AS touch_date FROM comms_history WHERE channel = 'outbound_call' AND campaign = 'RETENTION'",
)


@query(
    "attribute_orders",
    "WITH hits AS (SELECT o.account_no, o.order_no, o.order_ts, o.order_date, max(x.touch_date) AS last_touch FROM purchase_orders o JOIN sparse_touches x"
    f" ON o.account_no = x.account_no AND o.order_date - x.touch_date BETWEEN 0 AND 5 WHERE {EXCLUDED} GROUP BY 1, 2, 3, 4)"
    " SELECT account_no, order_no, order_date, last_touch FROM hits h WHERE order_ts = (SELECT max(order_ts) FROM hits g WHERE g.account_no = h.account_no)",
)
def _(t):
    touches = t.comms_history.where(
        (F.col("channel") == "outbound_call") & (F.col("campaign") == "RETENTION")
    ).select("account_no", F.col("comm_date").alias("touch_date"))
    return at.attribute_orders(touches, t.purchase_orders, days=5).select("account_no", "order_no", "order_date", "last_touch")


INBOUND_AREAS = "c2max|teleperformance|dispute|live|nps|assurance|outbound.+project|^retention^|social|tsi|voip.+cssr|callcenter|sales.+cssr"
fragment(
    "period_orders",
    f"SELECT *, {bundle_sql('cable_up', 'internet_up', 'phone_up')} AS new_bundle, CAST(CASE WHEN lower(stb_sc) LIKE '%dvr%' THEN 1 ELSE 0 END AS INT) AS new_dvr"
    f" FROM purchase_orders WHERE {EXCLUDED} AND order_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
    f" AND regexp_matches(lower(salesrep_area), '{INBOUND_AREAS}')",
)
fragment(
    "last_period_order",
    "SELECT account_no, order_no, order_date, ord_typ, new_bundle, new_dvr FROM (SELECT *, row_number() OVER (PARTITION BY account_no"
    " ORDER BY order_ts DESC, order_no) AS rn FROM period_orders WHERE new_bundle IS NOT NULL) WHERE rn = 1",
)


@query("latest_order_in_period", "SELECT * FROM last_period_order")
def _(t):
    return at.latest_order_in_period(t.purchase_orders, "2024-01-01", "2024-01-31").select(
        "account_no", "order_no", "order_date", "ord_typ", "new_bundle", "new_dvr"
    )


fragment(
    "recs",
    "SELECT *, CAST(substring(date_text, 1, 10) AS DATE) AS rec_date FROM recommendations WHERE date_text <> '0'"
    " AND CAST(substring(CASE WHEN date_text = '0' THEN '1900-01-01' ELSE date_text END, 1, 10) AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
)
fragment(
    "inbound_calls",
    f"SELECT account_no, start_date AS call_date FROM interactions WHERE regexp_matches(lower(channel), '{INBOUND_AREAS}')"
    " AND regexp_matches(lower(info), 'phone|contact.+center') AND start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
)
fragment(
    "answered",
    "SELECT r.rec_id, r.account_no, r.rec_date, r.pkg_cde, r.recommendedpkg, r.stb, max(c.call_date) AS call_date, s.first_call, s.last_call FROM recs r"
    " JOIN inbound_calls c ON r.account_no = c.account_no AND c.call_date BETWEEN r.rec_date AND r.rec_date + 30"
    " JOIN (SELECT account_no, min(call_date) AS first_call, max(call_date) AS last_call FROM inbound_calls GROUP BY 1) s ON r.account_no = s.account_no"
    " GROUP BY ALL",
)


@query("attribute_calls", "SELECT rec_id, account_no, rec_date, call_date, first_call, last_call FROM answered")
def _(t):
    recs = at.inbound_recommendations(t.recommendations, "2024-01-01", "2024-01-31")
    calls = at.inbound_calls(t.interactions, "2024-01-01", "2024-01-31")
    return at.attribute_calls(recs, calls).select("rec_id", "account_no", "rec_date", "call_date", "first_call", "last_call")


@query(
    "outbound_calls",
    "SELECT account_no, call_date, call_id, disposition, comments FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY call_date DESC, call_id) AS rn FROM"
    " (SELECT CAST(cuenta AS BIGINT) AS account_no, CAST(strptime(dial_text, '%m/%d/%Y') AS DATE) AS call_date, call_id, disposition, comments"
    " FROM call_feedback WHERE dial_text <> '')) WHERE rn = 1 AND call_date >= DATE '2024-01-10'",
)
def _(t):
    return at.outbound_calls(t.call_feedback, "2024-01-10")


@query(
    "best_touch_per_account",
    "SELECT account_no, rec_id, rec_date, recommendedpkg FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY CASE WHEN recommendedpkg = pkg_cde"
    " THEN 1 ELSE 2 END, rec_date DESC, rec_id) AS rn FROM recs) WHERE rn = 1",
)
def _(t):
    recs = at.inbound_recommendations(t.recommendations, "2024-01-01", "2024-01-31")
    exact = F.when(F.col("recommendedpkg") == F.col("pkg_cde"), 1).otherwise(2)
    best = at.best_touch_per_account(recs, [exact.asc(), F.col("rec_date").desc(), F.col("rec_id").asc()])
    return best.select("account_no", "rec_id", "rec_date", "recommendedpkg")


fragment(
    "timed_orders",
    f"SELECT order_no, order_date, {bundle_sql('cable_up', 'internet_up', 'phone_up')} AS new_bundle, substring(internet_up, 1, 5) AS target,"
    " order_date + 5 - CAST(order_no % 45 AS INT) AS sent, order_date + 8 - CAST(order_no % 45 AS INT) - CAST(order_no % 4 AS INT) AS called FROM purchase_orders",
)
MIGRATION = (
    "WITH f AS (SELECT *, CASE WHEN order_date < sent THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_sent,"
    " CASE WHEN order_date < called THEN 1 WHEN new_bundle IS NOT NULL THEN 0 END AS prior_to_call,"
    " CASE WHEN called <= order_date THEN 1 ELSE 0 END AS call_before_migration FROM timed_orders)"
    " SELECT order_no, prior_to_sent, prior_to_call, call_before_migration,"
    " CASE WHEN prior_to_sent = 0 AND prior_to_call = 0 AND call_before_migration = 1 THEN 1 ELSE 0 END AS migrated,"
    " CASE WHEN prior_to_sent = 0 AND sent <= called AND order_date <= sent + 30 AND called <= order_date THEN 1 ELSE 0 END AS migrated_one_month,"
    " CASE WHEN target <> new_bundle THEN 1 ELSE 0 END AS different_offer, CASE WHEN target = new_bundle THEN 1 ELSE 0 END AS accepted_recommendation FROM f"
)


@query("migration_flags", MIGRATION)
def _(t):
    shift = F.col("order_no") % 45
    orders = t.purchase_orders.select(
        "order_no",
        "order_date",
        pr.bundle_up().alias("new_bundle"),
        F.substring("internet_up", 1, 5).alias("target"),
        F.date_add("order_date", (5 - shift).cast("int")).alias("sent"),
        F.date_add("order_date", (8 - shift - F.col("order_no") % 4).cast("int")).alias("called"),
    )
    flagged = at.migration_flags(orders, sent="sent", call="called", target="target")
    return flagged.drop("order_date", "new_bundle", "target", "sent", "called")


fragment(
    "city_tenure",
    "SELECT account_no, city, addr1, CASE WHEN tenure BETWEEN 0 AND 0.5 THEN '0_6_months' WHEN tenure > 0.5 AND tenure <= 1 THEN '6_12_months'"
    " WHEN tenure > 1 AND tenure <= 2 THEN '1_2_years' WHEN tenure > 2 THEN 'more_than_2_years' END AS tenure_class FROM latest_csr",
)


@query(
    "enrich_city_tenure",
    "SELECT b.account_no, c.city, c.addr1, c.tenure_class FROM (SELECT DISTINCT account_no FROM purchase_orders) b LEFT JOIN city_tenure c ON b.account_no = c.account_no",
)
def _(t):
    return at.enrich_city_tenure(t.purchase_orders.select("account_no").distinct(), t.csr)


# ---- conversion checks -----------------------------------------------------

fragment(
    "last_plan_order",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY order_date DESC, order_no) AS rn FROM orders_activity"
    " WHERE lower(ord_typ) IN ('upgrade', 'downgrade', 'sidegrade')) WHERE rn = 1",
)


@query(
    "converted_within_days",
    f"SELECT c.account_no, c.comm_id, {day_of('sent_ms')} AS sent_date, {day_of('contact_ms')} AS contact_date, conv_type, o.order_no, o.order_date,"
    f" CAST(o.order_date - {day_of('contact_ms')} AS INT) AS days_to_order FROM comms_history c JOIN last_plan_order o ON c.account_no = o.account_no"
    f" WHERE channel = 'email' AND contact_ms IS NOT NULL AND {day_of('sent_ms')} >= DATE '2024-01-01' AND order_date >= DATE '2024-01-01'"
    f" AND order_date >= {day_of('contact_ms')} AND order_date - {day_of('sent_ms')} <= 15",
)
def _(t):
    out = cv.converted_within_days(t.comms_history, t.orders_activity, "2024-01-01")
    return out.select(
        "account_no", "comm_id", "sent_date", "contact_date", "conv_type", "order_no", "order_date", "days_to_order"
    )


CAMPAIGNS = ("UPSELL_TARGET", "UPSELL_CONTROL")


@query(
    "converted_comms_report",
    f"SELECT account_no, comm_id, campaign, use_case, {day_of('sent_ms')} AS sent_date, {day_of('contact_ms')} AS contact_date, {day_of('conv_ms')} AS conv_date,"
    f" {day_of('rec_ms')} AS recommended_date, conv_type, order_id FROM comms_history WHERE channel = 'email' AND {day_of('sent_ms')} >= DATE '2024-01-05'"
    " AND campaign IN ('UPSELL_TARGET', 'UPSELL_CONTROL') AND conv_ms IS NOT NULL AND conv_flg",
)
def _(t):
    return cv.converted_comms_report(t.comms_history, "2024-01-05", CAMPAIGNS).select(
        "account_no", "comm_id", "campaign", "use_case", "sent_date", "contact_date", "conv_date", "recommended_date", "conv_type", "order_id"
    )


@query(
    "comms_report",
    f"SELECT account_no, comm_id, {day_of('sent_ms')} AS sent_date, {day_of('contact_ms')} AS contact_date FROM comms_history WHERE channel = 'email'"
    f" AND {day_of('sent_ms')} >= DATE '2024-01-05' AND campaign IN ('UPSELL_TARGET', 'UPSELL_CONTROL')",
)
def _(t):
    return cv.converted_comms_report(t.comms_history, "2024-01-05", CAMPAIGNS, converted_only=False).select(
        "account_no", "comm_id", "sent_date", "contact_date"
    )


@query(
    "last_comms_on_day",
    f"SELECT account_no, {day_of('last_email_sent_ms')} AS last_email_sent, {day_of('last_email_contact_ms')} AS last_email_contact,"
    f" {day_of('last_email_conv_ms')} AS last_email_conv FROM last_comms WHERE {day_of('last_email_sent_ms')} = DATE '2024-01-30'",
)
def _(t):
    return cv.last_comms_on(cu.last_contacts(t.comms_history), "2024-01-30").select(
        "account_no", "last_email_sent", "last_email_contact", "last_email_conv"
    )


@query(
    "first_open_validation",
    "WITH opens AS (SELECT 8211000000000000 + user_id AS account_no, min(CAST(ts AS DATE) - 1) AS sent_at, min(CAST(ts AS DATE)) AS event_time FROM events"
    " WHERE event_type = 'click' AND CAST(ts AS DATE) - 1 >= DATE '2024-01-08' GROUP BY 1)"
    " SELECT h.account_no, h.comm_id, h.comm_date, h.open_date, o.sent_at, o.event_time FROM comms_history h JOIN opens o ON h.account_no = o.account_no"
    " WHERE h.comm_date >= DATE '2024-01-08'",
)
def _(t):
    opened = F.col("ts").cast("date")
    opens = t.events.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("contact_id"), F.date_sub(opened, 1).alias("sent_at"), opened.alias("event_time")
    )
    ids = t.customer.select(F.col("c_custkey").alias("contact_id"), (F.lit(8211000000000000) + F.col("c_custkey")).alias("account_no"))
    return cv.first_open_validation(opens, ids, t.comms_history, "2024-01-08").select(
        "account_no", "comm_id", "comm_date", "open_date", "sent_at", "event_time"
    )


@query(
    "service_call_conversion",
    f"SELECT account_no, call_id, call_date FROM service_calls WHERE service IN ('Tier2', 'CSR_SPA', 'Sales_ENG') AND action IN ('Answered', 'Call Complete')"
    f" AND agent_area IN ('C2MAX SALES', 'LivePerson', 'NPS CLOSED LOOP') AND {AS_OF_SQL} - call_date <= 30 AND account_no IN (SELECT account_no FROM offers)",
)
def _(t):
    return cv.service_call_conversion(t.service_calls, t.offers, AS_OF).select("account_no", "call_id", "call_date")


@query(
    "last_order_first_bill",
    "WITH lst AS (SELECT account_no, max(order_date) AS last_date FROM orders_activity WHERE ord_typ IN ('SIDEGRADE', 'UPGRADE', 'DOWNGRADE') GROUP BY 1)"
    " SELECT o.account_no, o.order_no, o.ord_typ, l.last_date, min(s.as_of) AS first_bill FROM lst l JOIN orders_activity o"
    " ON o.account_no = l.account_no AND o.order_date = l.last_date JOIN history s ON s.account_no = l.account_no AND s.as_of >= l.last_date"
    " AND (s.bill_code = substring(internet_up, 1, 5) OR s.bill_code = substring(cable_up, 1, 5) OR s.bill_code = substring(phone_up, 1, 5)) GROUP BY 1, 2, 3, 4",
)
def _(t):
    return cv.last_order_first_bill(t.orders_activity, _bill_history(t))


fragment(
    "history",
    "SELECT account_no, order_date + CAST(order_no % 9 AS INT) AS as_of, substring(internet_up, 1, 5) AS bill_code FROM orders_activity",
)


def _bill_history(t):
    """Bills that appear some days after each order."""
    return t.orders_activity.select(
        "account_no",
        F.date_add("order_date", (F.col("order_no") % 9).cast("int")).alias("as_of"),
        F.substring("internet_up", 1, 5).alias("bill_code"),
    )


@query(
    "account_key",
    "SELECT account_id, CAST(substring(account_id, 9, 16) AS BIGINT) AS account_no FROM latest_csr",
)
def _(t):
    from campanula.functions.keys import account_key

    return sn.latest_snapshot(t.csr, "as_of").select("account_id", account_key("account_id").alias("account_no"))


@query(
    "email_engagement",
    "SELECT email_id, campaign_title, CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) AS date_sent, CAST(strptime(date_opened, '%Y%m%d') AS DATE)"
    " AS date_opened, CASE WHEN date_opened IS NULL THEN 0 ELSE 1 END AS opened, CASE WHEN date_clicked IS NULL THEN 0 ELSE 1 END AS clicked FROM email_feedback f"
    " WHERE dt = (SELECT max(dt) FROM email_feedback g WHERE g.campaign_title = f.campaign_title)"
    " AND CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) >= DATE '2024-01-05'",
)
def _(t):
    return at.email_engagement(t.email_feedback, "2024-01-05").select(
        "email_id", "campaign_title", "date_sent", "date_opened", "opened", "clicked"
    )


fragment(
    "email_sent",
    "SELECT CAST(account AS BIGINT) AS account_no, email_id, campaign_title, CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) AS date_sent,"
    " CASE WHEN date_opened IS NULL THEN 0 ELSE 1 END AS opened, CASE WHEN date_clicked IS NULL THEN 0 ELSE 1 END AS clicked FROM email_feedback f"
    " WHERE dt = (SELECT max(dt) FROM email_feedback g WHERE g.campaign_title = f.campaign_title)"
    " AND CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) >= DATE '2024-01-01'",
)
fragment(
    "email_matched",
    "SELECT e.*, r.rec_id, r.regime, r.from_code, r.to_code, CAST(r.payment_dif AS INT) AS payment_dif, r.discount, r.stb, r.rec_date,"
    " CAST(trim(regexp_replace(CASE WHEN new_speed = '1 Giga' THEN '1000 Megas' ELSE new_speed END, '[^0-9 ]', '', 'g')) AS INT)"
    " - CAST(trim(regexp_replace(old_speed, '[^0-9 ]', '', 'g')) AS INT) AS speed_dif FROM email_sent e"
    " JOIN email_recommendations r ON e.account_no = r.account_no AND e.date_sent - r.rec_date BETWEEN 0 AND 1 WHERE r.rec_date >= DATE '2024-01-01'",
)


@query("email_offer_match", "SELECT account_no, email_id, rec_id, date_sent, rec_date, speed_dif, payment_dif FROM email_matched")
def _(t):
    engaged = at.email_engagement(t.email_feedback, "2024-01-01")
    return at.email_offer_match(engaged, t.email_recommendations, "2024-01-01").select(
        "account_no", "email_id", "rec_id", "date_sent", "rec_date", "speed_dif", "payment_dif"
    )
