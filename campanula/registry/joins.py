"""Joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from campanula.functions import dates as d
from campanula.functions.rules import flag
from campanula.operators import grouping as gr
from campanula.operators import joining as jn
from campanula.operators import ranking as rk
from campanula.operators import snapshot as sn
from campanula.operators.sets import union_months
from campanula.plans import conversion as cv
from campanula.plans import pricing as pr
from campanula.plans.collections import contact_rate
from campanula.plans.customers import accounts_per_phone, changed_speed
from campanula.plans.offers import offer_attributes
from campanula.registry.base import day_of, fragment, query

# ---- 2.4 joins -------------------------------------------------------------


@query(
    "inner_equi_join",
    "SELECT c_mktsegment AS segment, count(*) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS amount"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount")
    )


@query(
    "left_equi_join",
    "SELECT p.account_no, o.order_count, e.event_count, f.has_open_order FROM customer_profile p"
    " LEFT JOIN (SELECT account_no, count(*) AS order_count FROM orders_activity GROUP BY 1) o ON p.account_no = o.account_no"
    " LEFT JOIN (SELECT account_no, count(*) AS event_count FROM comms_history GROUP BY 1) e ON p.account_no = e.account_no"
    " LEFT JOIN account_flags f ON p.account_no = f.account_no",
)
def _(t):
    orders = t.orders_activity.groupBy("account_no").agg(F.count(F.lit(1)).alias("order_count"))
    events = t.comms_history.groupBy("account_no").agg(F.count(F.lit(1)).alias("event_count"))
    flags = t.account_flags.select("account_no", "has_open_order")
    base = t.customer_profile.select("account_no")
    return jn.join_left(base, [(orders, "account_no"), (events, "account_no"), (flags, "account_no")])


@query(
    "left_join_then_filter",
    "SELECT c_custkey, count(*) AS errors FROM customer LEFT JOIN events ON c_custkey = user_id"
    " WHERE event_type = 'error' GROUP BY 1",
)
def _(t):
    errors = t.events.where(F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))
    return t.customer.select("c_custkey").join(errors, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "errors")


@query(
    "cast_key_join",
    "SELECT f.email_id, p.account_no, p.down_speed FROM email_feedback f JOIN customer_profile p"
    " ON CAST(f.account AS BIGINT) = p.account_no",
)
def _(t):
    from campanula.functions.keys import normalize_key

    sent = t.email_feedback.select("email_id", normalize_key("account").alias("account_no"))
    return sent.join(t.customer_profile.select("account_no", "down_speed"), "account_no")


fragment("prices", "SELECT package_code, CAST(round(min(price), 2) AS DOUBLE) AS price, min(description) AS description FROM package_prices GROUP BY 1")


@query(
    "self_role_join",
    "SELECT o.account_no, o.offer_id, o.offer_rank, o.pkg_cde, o.recommendedpkg, a.price AS old_price, b.price AS new_price FROM offers o"
    " LEFT JOIN prices a ON o.pkg_cde = a.package_code LEFT JOIN prices b ON o.recommendedpkg = b.package_code",
)
def _(t):
    prices = pr.package_price_panel(t.package_prices).select("package_code", "price")
    joined = jn.role_join(t.offers, prices, "package_code", {"old": "pkg_cde", "new": "recommendedpkg"})
    return joined.select("account_no", "offer_id", "offer_rank", "pkg_cde", "recommendedpkg", "old_price", "new_price")


@query("left_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(t):
    buyers = t.events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("c_custkey"))
    return jn.semi(t.customer.select("c_custkey", "c_name"), buyers, "c_custkey")


@query(
    "left_anti_join",
    "SELECT c.account_no, c.package_code FROM customer_profile c"
    " LEFT JOIN (SELECT DISTINCT account_no FROM offers WHERE regime = 'control_x') a ON c.account_no = a.account_no"
    " LEFT JOIN (SELECT DISTINCT account_no FROM comms_history WHERE channel = 'email') b ON c.account_no = b.account_no"
    " WHERE a.account_no IS NULL AND b.account_no IS NULL",
)
def _(t):
    control = t.offers.where(F.col("regime") == "control_x").select("account_no")
    mailed = t.comms_history.where(F.col("channel") == "email").select("account_no")
    return jn.anti(t.customer_profile.select("account_no", "package_code"), control, mailed, on="account_no")


@query(
    "audience_intersect_join",
    "SELECT DISTINCT p.account_no FROM customer_profile p JOIN (SELECT DISTINCT account_no FROM offers WHERE lower(channel) = 'email') a"
    " ON p.account_no = a.account_no JOIN (SELECT DISTINCT account_no FROM orders_activity WHERE ord_typ = 'UPGRADE') b"
    " ON p.account_no = b.account_no JOIN (SELECT DISTINCT account_no FROM account_flags WHERE has_open_order IS NULL) c"
    " ON p.account_no = c.account_no",
)
def _(t):
    return jn.intersect_ids(
        t.customer_profile,
        t.offers.where(F.lower("channel") == "email"),
        t.orders_activity.where(F.col("ord_typ") == "UPGRADE"),
        t.account_flags.where(F.col("has_open_order").isNull()),
        on="account_no",
    )


@query(
    "interval_join_days",
    "SELECT r.rec_id, f.email_id, r.account_no, CAST(date_diff('day', r.rec_date, f.sent) AS INT) AS days FROM email_recommendations r"
    " JOIN (SELECT email_id, CAST(account AS BIGINT) AS account_no, CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) AS sent"
    " FROM email_feedback) f ON r.account_no = f.account_no WHERE date_diff('day', r.rec_date, f.sent) BETWEEN 0 AND 1",
)
def _(t):
    sent = t.email_feedback.select(
        "email_id", F.col("account").cast("bigint").alias("account_no"), d.parse_yyyymmdd("date_sent").alias("sent")
    )
    recs = t.email_recommendations.select("rec_id", "account_no", "rec_date")
    pairs = jn.interval_join(recs, sent, "account_no", "rec_date", "sent", 0, 1)
    return pairs.select("rec_id", "email_id", "account_no", d.days_between("rec_date", "sent").alias("days"))


@query(
    "interval_nearest_days",
    "SELECT l.account_no, l.comm_date, max(r.order_date) AS latest_order FROM (SELECT DISTINCT account_no, comm_date FROM comms_history) l"
    " JOIN purchase_orders r ON l.account_no = r.account_no AND r.order_date - l.comm_date BETWEEN 2 AND 9 GROUP BY 1, 2",
)
def _(t):
    return jn.nearest_in_window(
        t.comms_history, t.purchase_orders, "account_no", "comm_date", "order_date", 2, 9, "latest_order"
    )


@query(
    "month_equi_join",
    "SELECT a.account_no, a.month, c.calls FROM (SELECT DISTINCT account_no, CAST(date_trunc('month', dt) AS DATE) AS month FROM daily_activity) a"
    " JOIN (SELECT account_no, CAST(date_trunc('month', start_date) AS DATE) AS month, count(DISTINCT interaction_id) AS calls"
    " FROM interactions WHERE purpose = 'CLAIM' GROUP BY 1, 2) c ON a.account_no = c.account_no AND a.month = c.month",
)
def _(t):
    active = t.daily_activity.select("account_no", d.month_start("dt").alias("month")).distinct()
    calls = (
        t.interactions.where(F.col("purpose") == "CLAIM")
        .groupBy("account_no", d.month_start("start_date").alias("month"))
        .agg(F.count_distinct("interaction_id").alias("calls"))
    )
    return active.join(calls, ["account_no", "month"])


fragment(
    "asset_prices",
    "SELECT a.package_code, CAST(round(sum(a.charge), 2) AS DOUBLE) AS price FROM assets a JOIN (SELECT package_code, max(dt) AS dt"
    " FROM assets GROUP BY 1) m ON a.package_code = m.package_code AND a.dt = m.dt GROUP BY 1",
)


@query(
    "or_equi_join",
    "WITH coded AS (SELECT account_no, order_no, month_amount - before_amount AS order_delta,"
    " substring(phone_up, 1, 5) AS phone_code, substring(cable_up, 1, 5) AS cable_code, substring(internet_up, 1, 5) AS internet_code"
    " FROM orders_activity) SELECT c.*, p.price AS package_price FROM coded c LEFT JOIN asset_prices p"
    " ON phone_code = p.package_code OR cable_code = p.package_code OR internet_code = p.package_code",
)
def _(t):
    return cv.order_package_prices(t.orders_activity, pr.asset_price(t.assets))


@query(
    "theta_case_join",
    "SELECT o.account_no, o.offer_id, o.offer_rank, o.recommendedpkg, o.delta_arpu, p.price FROM offers o LEFT JOIN prices p ON o.recommendedpkg = p.package_code"
    " AND o.discount <= p.price AND CASE WHEN lower(o.stb) LIKE '%dvr%' THEN p.price + 5 > o.delta_arpu + 70 ELSE p.price > o.delta_arpu + 70 END",
)
def _(t):
    prices = pr.package_price_panel(t.package_prices).select("package_code", "price")
    offers = t.offers.withColumn("dvr", pr.has_dvr("stb"))
    wanted = F.col("delta_arpu") + 70
    dearer = F.when(F.col("dvr") == 1, F.col("price") + 5 > wanted).otherwise(F.col("price") > wanted)
    cheap = (F.col("discount") <= F.col("price")) & dearer
    joined = jn.theta_join(offers, prices, {"recommendedpkg": "package_code"}, {"price": "price"}, cheap)
    return joined.select("account_no", "offer_id", "offer_rank", "recommendedpkg", "delta_arpu", "price")


@query(
    "cross_join_filtered",
    f"SELECT v.account_no, v.conv_date, max(c.comm_date) AS last_comm FROM (SELECT DISTINCT account_no, {day_of('conv_ms')} AS conv_date"
    " FROM comms_history WHERE conv_ms IS NOT NULL) v JOIN comms_history c ON v.account_no = c.account_no"
    " WHERE v.conv_date >= c.comm_date GROUP BY 1, 2",
)
def _(t):
    return cv.conversions_after_comms(cv.conversion_dates(t.comms_history), t.comms_history)


@query(
    "asof_forward_join",
    "SELECT l.account_no, l.last_order, min(s.as_of) AS next_snapshot FROM (SELECT account_no, max(order_date) AS last_order"
    " FROM orders_activity GROUP BY 1) l JOIN csr s ON l.account_no = s.account_no AND s.as_of >= l.last_order GROUP BY 1, 2",
)
def _(t):
    last = t.orders_activity.groupBy("account_no").agg(F.max("order_date").alias("last_order"))
    return jn.asof_forward(last, t.csr.select("account_no", "as_of"), ["account_no"], "last_order", "as_of", "next_snapshot")


# ---- 2.5 aggregations ------------------------------------------------------


@query(
    "count_distinct_by",
    "SELECT CAST(year(o_orderdate) AS INT) AS order_year, o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers"
    " FROM orders GROUP BY 1, 2",
)
def _(t):
    return gr.count_distinct(
        t.orders, {"order_year": F.year("o_orderdate"), "priority": F.col("o_orderpriority")}, "o_custkey", "customers"
    )


@query("count_non_null", "SELECT account_no, count(email) AS emails, count(home_phone) AS phones, count(*) AS snapshots FROM csr GROUP BY 1")
def _(t):
    return t.csr.groupBy("account_no").agg(
        F.count("email").alias("emails"), F.count("home_phone").alias("phones"), F.count(F.lit(1)).alias("snapshots")
    )


@query("sum_group", "SELECT o_custkey, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS paid FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("paid"))


@query("min_group", "SELECT package_code, min(price) AS price FROM package_prices GROUP BY 1")
def _(t):
    return t.package_prices.groupBy("package_code").agg(F.min("price").alias("price"))


@query("max_group", "SELECT account_no, max(order_date) AS last_order FROM orders_activity GROUP BY 1")
def _(t):
    return t.orders_activity.groupBy("account_no").agg(F.max("order_date").alias("last_order"))


@query(
    "conditional_max",
    "SELECT account_no, max(pkg_cde) AS from_package, max(CASE WHEN lower(channel) = 'email' THEN discount END) AS email_discount,"
    " max(CASE WHEN lower(offer_type) = 'single' THEN recommended_ms END) AS single_recommended_ms FROM offers GROUP BY 1",
)
def _(t):
    return offer_attributes(t.offers, ["from_package", "email_discount", "single_recommended_ms"])


@query(
    "ratio_of_conditional_sums",
    "SELECT account, CASE WHEN den > 0 THEN ((200 * num + den) // (2 * den)) / 100 END AS contact_rate FROM (SELECT coalesce(field_1, field_2) AS account,"
    " count(*) FILTER (child_outcome IS DISTINCT FROM 'No contesta1') AS num, count(contact_id) AS den FROM dialer_history GROUP BY 1)",
)
def _(t):
    return contact_rate(t.dialer_history)


@query("distinct_flag", "SELECT account_no, count(DISTINCT hsd_speed) > 1 AS changed_speed FROM csr GROUP BY 1")
def _(t):
    return changed_speed(t.csr)


@query(
    "collect_and_join",
    "SELECT account, lower(array_to_string(list_sort(list(category)), ',')) AS category FROM exclusions GROUP BY 1",
)
def _(t):
    return gr.fold_strings(t.exclusions, ["account"], "category", "category").drop("entries")


@query(
    "collect_array",
    "SELECT interaction_id, array_to_string(list_sort(list(DISTINCT status)), '|') AS statuses, CAST(count(DISTINCT status) AS INT) AS n"
    " FROM interactions GROUP BY 1",
)
def _(t):
    grouped = t.interactions.groupBy("interaction_id").agg(F.collect_set("status").alias("all"))
    return grouped.select(
        "interaction_id", F.array_join(F.array_sort("all"), "|").alias("statuses"), F.size("all").alias("n")
    )


@query("any_value", "SELECT package_code, min(description) AS description FROM package_prices GROUP BY 1")
def _(t):
    return pr.package_price_panel(t.package_prices, "any").select("package_code", "description")


@query("select_distinct", "SELECT DISTINCT account_no, pkg_cde FROM offers")
def _(t):
    return t.offers.select("account_no", "pkg_cde").distinct()


@query(
    "group_by_ordinal",
    "SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_month, lower(ord_typ) AS kind, count(DISTINCT order_no) AS orders"
    " FROM orders_activity GROUP BY 1, 2",
)
def _(t):
    return gr.count_distinct(
        t.orders_activity, {"order_month": d.month_start("order_date"), "kind": F.lower("ord_typ")}, "order_no", "orders"
    )


@query(
    "two_level_rollup_check",
    "SELECT order_year, CAST(sum(customers) AS BIGINT) AS customers FROM (SELECT CAST(year(o_orderdate) AS INT) AS order_year, o_orderstatus,"
    " count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    inner = gr.count_distinct(
        t.orders, {"order_year": F.year("o_orderdate"), "status": F.col("o_orderstatus")}, "o_custkey", "customers"
    )
    return inner.groupBy("order_year").agg(F.sum("customers").alias("customers"))


@query(
    "min_of_expression",
    "SELECT CAST(month(ts) AS INT) AS month, CAST(min(day(ts)) AS INT) AS first_day, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def _(t):
    return t.events.groupBy(F.month("ts").alias("month")).agg(
        F.min(F.dayofmonth("ts")).alias("first_day"), F.count_distinct("user_id").alias("users")
    )


# ---- 2.6 windows -----------------------------------------------------------


@query(
    "row_number_top1",
    "SELECT account_no, order_no, order_date, month_amount FROM (SELECT *, row_number() OVER (PARTITION BY account_no ORDER BY order_date DESC,"
    " month_amount, order_no) AS rn FROM orders_activity) WHERE rn = 1",
)
def _(t):
    order = [F.col("order_date").desc(), F.col("month_amount").asc(), F.col("order_no").asc()]
    return sn.latest_row(t.orders_activity, ["account_no"], order).select("account_no", "order_no", "order_date", "month_amount")


@query(
    "row_number_case_order",
    "SELECT account_no, order_no FROM (SELECT account_no, order_no, row_number() OVER (PARTITION BY account_no ORDER BY"
    " (CASE WHEN month_amount - before_amount >= 10 THEN 1 ELSE 0 END) DESC, order_date, order_no) AS rn FROM orders_activity) WHERE rn = 1",
)
def _(t):
    order = [flag(F.col("month_amount") - F.col("before_amount") >= 10).desc(), F.col("order_date").asc(), F.col("order_no").asc()]
    return sn.latest_row(t.orders_activity, ["account_no"], order).select("account_no", "order_no")


@query(
    "row_number_conditional_ranking",
    "SELECT c_custkey, c_mktsegment, CAST(CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN row_number() OVER (PARTITION BY c_mktsegment"
    " ORDER BY c_nationkey, c_custkey) ELSE row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey % 5 DESC, c_custkey) END AS INT) AS place"
    " FROM customer",
)
def _(t):
    first = F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")
    keyed = t.customer.select(
        "c_custkey",
        "c_mktsegment",
        F.when(first, F.col("c_nationkey")).alias("up"),
        F.when(~first, F.col("c_nationkey") % 5).alias("down"),
    )
    ranked = rk.rank_large(keyed, ["c_mktsegment"], [("up", False), ("down", True)], "c_custkey", "place")
    return ranked.select("c_custkey", "c_mktsegment", "place")


@query(
    "first_value_asc_desc",
    "SELECT DISTINCT interaction_id, first_value(status) OVER (PARTITION BY interaction_id ORDER BY start_ts, status) AS first_status,"
    " first_value(status) OVER (PARTITION BY interaction_id ORDER BY start_ts DESC, status DESC) AS last_status FROM interactions",
)
def _(t):
    # one pass, combined before the shuffle, instead of two window sorts
    return t.interactions.groupBy("interaction_id").agg(
        F.min_by("status", F.struct("start_ts", "status")).alias("first_status"),
        F.max_by("status", F.struct("start_ts", "status")).alias("last_status"),
    )


@query(
    "first_value_coalesce",
    "SELECT DISTINCT account, coalesce(first_value(outcome) OVER w, first_value(child_outcome) OVER w) AS outcome FROM"
    " (SELECT coalesce(field_1, field_2, field_3) AS account, * FROM dialer_attempts) WHERE account IS NOT NULL"
    " WINDOW w AS (PARTITION BY account ORDER BY attempt_id DESC)",
)
def _(t):
    named = t.dialer_attempts.withColumn("account", F.coalesce("field_1", "field_2", "field_3")).where(F.col("account").isNotNull())
    last = sn.latest_values(named, ["account"], [F.col("attempt_id").desc()], ["outcome", "child_outcome"])
    return last.select("account", F.coalesce("outcome", "child_outcome").alias("outcome"))


@query(
    "window_over_aggregate",
    "SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS INT) AS place FROM"
    " (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)",
)
def _(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rk.rank_within(counts, ["user_id"], [F.col("n").desc(), F.col("event_type").asc()], "place")


@query(
    "lag_gap",
    "SELECT account_no, dt, previous, CAST(dt - previous AS INT) AS gap_days FROM (SELECT account_no, dt, lag(dt) OVER (PARTITION BY account_no"
    " ORDER BY dt) AS previous FROM (SELECT DISTINCT account_no, dt FROM daily_activity)) WHERE dt - previous > 1",
)
def _(t):
    return rk.gaps(t.daily_activity, ["account_no"], "dt")


@query(
    "count_distinct_over_partition",
    "SELECT a.account_no, a.home_phone, b.num_accounts FROM latest_csr a JOIN (SELECT home_phone, count(DISTINCT account_no) AS num_accounts"
    " FROM latest_csr GROUP BY 1) b ON a.home_phone IS NOT DISTINCT FROM b.home_phone",
)
def _(t):
    return accounts_per_phone(sn.latest_snapshot(t.csr, "as_of"))


# ---- 2.7 sorts, limits, top-k; 2.8 sets ------------------------------------


@query(
    "order_by",
    "SELECT account_no, as_of, home_phone, tenure FROM latest_csr ORDER BY home_phone ASC NULLS LAST, tenure DESC NULLS LAST, account_no",
)
def _(t):
    kept = sn.latest_snapshot(t.csr, "as_of").select("account_no", "as_of", "home_phone", "tenure")
    return kept.orderBy(F.asc_nulls_last("home_phone"), F.desc_nulls_last("tenure"), F.asc("account_no"))


@query("order_by_inner", "SELECT ord_typ, max(order_date) AS last_order FROM (SELECT * FROM orders_activity ORDER BY order_date DESC) GROUP BY 1")
def _(t):
    return t.orders_activity.groupBy("ord_typ").agg(F.max("order_date").alias("last_order"))


@query(
    "limit_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(100)


@query(
    "topk_capacity",
    "SELECT c_mktsegment, c_custkey, CAST(position AS INT) AS position FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment"
    " ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 400 * 0.1",
)
def _(t):
    best = rk.top_capacity(t.customer, ["c_mktsegment"], [("c_acctbal", True), ("c_custkey", False)], 400, 0.1)
    return best.select("c_mktsegment", "c_custkey", "position")


@query(
    "union_all_months",
    "SELECT 1 AS month, o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2000-02-01' UNION ALL"
    " SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '2000-02-01' AND o_orderdate < DATE '2000-03-01' UNION ALL"
    " SELECT 3, o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '2000-03-01' AND o_orderdate < DATE '2000-04-01'",
)
def _(t):
    bounds = ["2000-01-01", "2000-02-01", "2000-03-01", "2000-04-01"]
    parts = [
        t.orders.where((F.col("o_orderdate") >= d.to_date_lit(lo)) & (F.col("o_orderdate") < d.to_date_lit(hi))).select(
            F.lit(i + 1).alias("month"), "o_orderkey", "o_custkey"
        )
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
    ]
    return union_months(*parts)
