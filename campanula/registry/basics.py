"""Sources, snapshots, projections, filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campanula.functions import dates as d
from campanula.functions import keys, text
from campanula.functions.rules import bucket, is_x, neq_or_null, value_map
from campanula.operators import snapshot as sn
from campanula.operators.grouping import count_distinct, fold_strings, multiset
from campanula.plans import attribution as at
from campanula.plans.collections import DIALER_FIELDS
from campanula.plans.offers import VIDEO_SERVICES
from campanula.registry.base import AS_OF, AS_OF_SQL, day_of, fragment, query
from campanula.sources import tables as src

# ---- 2.1 sources and sinks -------------------------------------------------


@query("scan_table", "SELECT * FROM supplier")
def _(t):
    return src.scan(t.supplier)


@query(
    "scan_partition_filter",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
)
def _(t):
    return src.scan(t.events, partition={"event_type": "purchase"}, columns=["event_id", "user_id", "value"])


@query("scan_since_date", "SELECT event_id, user_id, event_type FROM events WHERE ts >= DATE '2024-01-20'")
def _(t):
    return src.scan(t.events, since=("ts", "2024-01-20"), columns=["event_id", "user_id", "event_type"])


@query(
    "project_event_feed",
    "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS event_date, value, props FROM events"
    " WHERE event_type = 'click' AND ts >= DATE '2024-01-10'",
)
def _(t):
    feed = src.scan(t.events, since=("ts", "2024-01-10"), partition={"event_type": "click"})
    return feed.select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("event_date"), "value", "props")


@query(
    "define_view",
    "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1",
)
def _(t):
    view = src.define_view(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "campaign_customers")
    return view.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


def _order_extract(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("o_orderpriority").alias("priority"),
    )


def _exported(t, out, name, **options):
    path = f"{src.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    src.export_csv(out, path, **options)
    return path


@query(
    "export_csv",
    "SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderpriority AS priority FROM orders",
)
def _(t):
    out = _order_extract(t)
    return t.spark.read.csv(_exported(t, out, "export_csv"), header=True, schema=out.schema)


@query(
    "export_csv_single_file",
    "SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderpriority AS priority, 1 AS files FROM orders",
)
def _(t):
    """The hand-over extract, sorted and in one file, read back with the number of its files."""
    out = _order_extract(t)
    path = _exported(t, out, "export_single", single_file=True, order=[F.asc("order_key")])
    back = t.spark.read.csv(path, header=True, schema=out.schema)
    files = back.select(F.count_distinct("_metadata.file_name").cast("int")).scalar()
    return back.withColumn("files", files)


@query(
    "export_links_for_day",
    f"SELECT account_no, offer_id, offer_rank, recommendedpkg, link, {day_of('link_ms')} AS link_date FROM offers"
    f" WHERE {day_of('link_ms')} = DATE '2024-01-25' AND link IS NOT NULL",
)
def _(t):
    kept = src.links_for_day(t.offers, "2024-01-25")
    return kept.select(
        "account_no", "offer_id", "offer_rank", "recommendedpkg", "link", d.epoch_ms_to_date("link_ms").alias("link_date")
    )


# ---- 2.2 snapshots ---------------------------------------------------------


@query(
    "latest_snapshot",
    "SELECT account_no, as_of, bill_code, delinquency_days FROM csr WHERE as_of = (SELECT max(as_of) FROM csr)",
)
def _(t):
    return sn.latest_snapshot(t.csr, "as_of").select("account_no", "as_of", "bill_code", "delinquency_days")


@query(
    "snapshot_at",
    f"SELECT account_no, as_of, bill_code, as_of_ms FROM csr WHERE as_of = {AS_OF_SQL} - 1"
    f" AND as_of_ms = epoch_ms(CAST({AS_OF_SQL} - 1 AS TIMESTAMP))",
)
def _(t):
    by_day = sn.snapshot_at(t.csr, "as_of", F.date_sub(d.to_date_lit(AS_OF), 1))
    by_ms = sn.snapshot_at(by_day, "as_of_ms", src.to_epoch_ms("2024-01-30"))
    return by_ms.select("account_no", "as_of", "bill_code", "as_of_ms")


@query(
    "first_of_month_snapshot",
    "SELECT account_no, dt, customer_type FROM monthly_snapshot WHERE dt = date_trunc('month', dt)",
)
def _(t):
    return sn.first_of_month(t.monthly_snapshot, "dt").select("account_no", "dt", "customer_type")


@query(
    "latest_per_key_join",
    "SELECT a.account_no, a.order_no, a.order_date, a.ord_typ FROM orders_activity a JOIN"
    " (SELECT account_no, max(order_date) AS latest FROM orders_activity GROUP BY 1) m"
    " ON a.account_no = m.account_no AND a.order_date = m.latest",
)
def _(t):
    return sn.latest_ties(t.orders_activity, ["account_no"], "order_date").select(
        "account_no", "order_no", "order_date", "ord_typ"
    )


@query(
    "latest_per_key_first_value",
    "SELECT DISTINCT account_no, first_value(city) OVER w AS city, first_value(hsd_speed) OVER w AS hsd_speed,"
    " first_value(tenure) OVER w AS tenure FROM csr WINDOW w AS (PARTITION BY account_no ORDER BY as_of DESC)",
)
def _(t):
    return sn.latest_values(t.csr, ["account_no"], [F.col("as_of").desc()], ["city", "hsd_speed", "tenure"])


@query("first_event_per_key", "SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1")
def _(t):
    days = t.events.select("user_id", F.col("ts").cast("date").alias("first_day"))
    return sn.first_event(days, ["user_id"], ["first_day"])


# ---- 2.3 projections, filters, predicates ----------------------------------


@query(
    "project_rename_extend",
    "SELECT o_orderkey AS order_id, o_custkey AS account, o_totalprice AS amount,"
    " o_totalprice * 0.1 AS tax, upper(o_orderpriority) AS priority FROM orders",
)
def _(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_totalprice") * 0.1).alias("tax"),
        F.upper("o_orderpriority").alias("priority"),
    )


@query(
    "lateral_alias_project",
    f"SELECT comm_id, {day_of('sent_ms')} AS sent_date, {AS_OF_SQL} - 21 AS period,"
    f" {day_of('sent_ms')} >= {AS_OF_SQL} - 21 AS recent FROM comms_history",
)
def _(t):
    dated = t.comms_history.withColumn("sent_date", d.epoch_ms_to_date("sent_ms"))
    compared = dated.withColumn("period", F.date_sub(d.to_date_lit(AS_OF), 21))
    return compared.select("comm_id", "sent_date", "period", (F.col("sent_date") >= F.col("period")).alias("recent"))


@query(
    "alias_in_where",
    f"SELECT comm_id, {day_of('sent_ms')} AS sent_date FROM comms_history"
    f" WHERE {day_of('sent_ms')} >= DATE '2024-01-15' AND channel = 'email'",
)
def _(t):
    dated = t.comms_history.withColumn("sent_date", d.epoch_ms_to_date("sent_ms"))
    kept = dated.where((F.col("sent_date") >= d.to_date_lit("2024-01-15")) & (F.col("channel") == "email"))
    return kept.select("comm_id", "sent_date")


@query("in_list_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY','HOUSEHOLD')")
def _(t):
    return t.customer.where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select("c_custkey", "c_mktsegment")


@query("not_in_filter", "SELECT order_no, ord_typ FROM orders_activity WHERE ord_typ NOT IN ('CONNECT','V_DISCO','NON PAY','RESTART')")
def _(t):
    return at.plan_orders(t.orders_activity).select("order_no", "ord_typ")


@query(
    "between_filter",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders"
    " WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND o_totalprice BETWEEN 1000 AND 250000",
)
def _(t):
    kept = t.orders.where(
        F.col("o_orderdate").between(d.to_date_lit("1997-01-01"), d.to_date_lit("1997-12-31"))
        & F.col("o_totalprice").between(1000, 250000)
    )
    return kept.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))


@query(
    "like_filter",
    "SELECT account_no, offer_id, offer_rank, channel, param_3 FROM offers WHERE lower(param_3) LIKE '%si deseas el%'"
    " AND lower(channel) LIKE '%call%center%' AND lower(time_frame) LIKE 'afternoon'",
)
def _(t):
    kept = t.offers.where(
        F.lower("param_3").like("%si deseas el%")
        & F.lower("channel").like("%call%center%")
        & F.lower("time_frame").like("afternoon")
    )
    return kept.select("account_no", "offer_id", "offer_rank", "channel", "param_3")


@query(
    "multi_like_exclude",
    "SELECT attempt_id, lower(outcome) AS outcome FROM dialer_attempts WHERE outcome IS NULL OR NOT ("
    "lower(outcome) LIKE '%equivocado%' OR lower(outcome) LIKE '%success%' OR lower(outcome) LIKE '%cesada%')",
)
def _(t):
    low = t.dialer_attempts.select("attempt_id", F.lower("outcome").alias("outcome"))
    return low.where(text.like_none("outcome", ["%equivocado%", "%success%", "%cesada%"]))


@query(
    "regex_filter",
    "SELECT order_no, salesrep_area FROM purchase_orders WHERE regexp_matches(lower(salesrep_area),"
    " 'c2max|teleperformance|dispute|live|nps|assurance|outbound.+project|^retention^|social|tsi"
    "|voip.+cssr|callcenter|sales.+cssr')",
)
def _(t):
    return t.purchase_orders.where(text.matches("salesrep_area", at.INBOUND_AREAS)).select("order_no", "salesrep_area")


@query(
    "neq_or_null_filter",
    "SELECT account_no, offer_id, offer_rank, stb FROM offers WHERE stb <> 'HD-DVR' OR stb IS NULL",
)
def _(t):
    return t.offers.where(neq_or_null("stb", "HD-DVR")).select("account_no", "offer_id", "offer_rank", "stb")


@query(
    "null_checks",
    "SELECT account_no, as_of, email, home_phone FROM csr WHERE email IS NOT NULL AND home_phone IS NULL",
)
def _(t):
    kept = t.csr.where(F.col("email").isNotNull() & F.col("home_phone").isNull())
    return kept.select("account_no", "as_of", "email", "home_phone")


@query(
    "business_rule_filter",
    "SELECT account, dt, outstanding_amount FROM dna WHERE customer_name IS NOT NULL AND outstanding_amount > 0 AND mix <> '0P'",
)
def _(t):
    kept = t.dna.where(F.col("customer_name").isNotNull()).where(F.col("outstanding_amount") > 0).where(F.col("mix") != "0P")
    return kept.select("account", "dt", "outstanding_amount")


@query(
    "case_bucket",
    "SELECT account, CASE WHEN decile <= 2 THEN 'High' WHEN decile >= 3 AND decile < 9 THEN 'Medium' ELSE 'Low' END AS risk,"
    " CASE WHEN score < 0.25 THEN 'q1' WHEN score < 0.5 THEN 'q2' END AS band, week FROM risk_scores",
)
def _(t):
    c = F.col("decile")
    return t.risk_scores.select(
        "account",
        bucket([(c <= 2, "High"), (c.between(3, 8), "Medium")], "Low").alias("risk"),
        bucket([(F.col("score") < 0.25, "q1"), (F.col("score") < 0.5, "q2")]).alias("band"),
        "week",
    )


@query(
    "nested_case",
    "SELECT order_no, CASE WHEN month_amount - before_amount > 20 THEN 'UP' ELSE (CASE WHEN month_amount - before_amount > 5"
    " THEN 'SLIGHT' ELSE (CASE WHEN ord_typ = 'DOWNGRADE' THEN 'DOWN' ELSE 'EQUAL' END) END) END AS direction FROM orders_activity",
)
def _(t):
    change = F.col("month_amount") - F.col("before_amount")
    label = bucket([(change > 20, "UP"), (change > 5, "SLIGHT"), (F.col("ord_typ") == "DOWNGRADE", "DOWN")], "EQUAL")
    return t.orders_activity.select("order_no", label.alias("direction"))


@query(
    "case_value_map",
    "SELECT account_no, CASE video_service WHEN 'BASIC' THEN 'Basic' WHEN 'CHOICE PACK' THEN 'Choice Pack'"
    " WHEN 'ESP PRIMERA' THEN 'EDP' WHEN 'ULTIMATE' THEN 'Ultimate' WHEN 'UPICK' THEN 'UPICK' END AS tv FROM customer_profile",
)
def _(t):
    return t.customer_profile.select("account_no", value_map("video_service", VIDEO_SERVICES).alias("tv"))


@query(
    "flag_to_boolean",
    "SELECT account_no, coalesce(has_privacy_flag = 'X', false) AS privacy_flag, coalesce(has_open_order = 'X', false) AS open_order,"
    " coalesce(pending_tc = 'X', false) AS trouble_call FROM account_flags",
)
def _(t):
    return t.account_flags.select(
        "account_no",
        is_x("has_privacy_flag").alias("privacy_flag"),
        is_x("has_open_order").alias("open_order"),
        is_x("pending_tc").alias("trouble_call"),
    )


@query("constant_columns", "SELECT c_custkey, ' ' AS email_id, 'Offerfit' AS final_group FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lit(" ").alias("email_id"), F.lit("Offerfit").alias("final_group"))


@query(
    "param_scalar_subquery",
    "WITH parameters AS (SELECT DATE '2023-06-01' AS start_date, DATE '2023-12-31' AS end_date)"
    " SELECT order_no, order_date FROM orders_activity WHERE order_date BETWEEN (SELECT start_date FROM parameters)"
    " AND (SELECT end_date FROM parameters)",
)
def _(t):
    period = (d.to_date_lit("2023-06-01"), d.to_date_lit("2023-12-31"))
    return t.orders_activity.where(F.col("order_date").between(*period)).select("order_no", "order_date")


@query(
    "precedence_or_and",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"
    " WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' AND o_totalprice >= 200000",
)
def _(t):
    kept = t.orders.where(
        (F.col("o_orderstatus") == "P") | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= 200000))
    )
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


# ---- 2.9 scalar functions --------------------------------------------------


@query("string_case_trim", "SELECT part_key, lower(trim(description)) AS name, upper(description) AS shout FROM package_prices")
def _(t):
    return t.package_prices.select("part_key", F.lower(F.trim("description")).alias("name"), F.upper("description").alias("shout"))


@query(
    "string_substring",
    "SELECT order_no, substring(cable_up, 1, 5) AS cable, substring(internet_up, 2, 1) AS mask FROM orders_activity",
)
def _(t):
    return t.orders_activity.select(
        "order_no", F.substring("cable_up", 1, 5).alias("cable"), F.substring("internet_up", 2, 1).alias("mask")
    )


@query(
    "string_suffix",
    "SELECT account_no, substring(CAST(account_no AS VARCHAR), length(CAST(account_no AS VARCHAR)) - 1, 2) AS suffix,"
    " substring(CAST(account_no AS VARCHAR), 15, 16) AS group_id FROM customer_profile",
)
def _(t):
    return t.customer_profile.select(
        "account_no",
        text.suffix("account_no").alias("suffix"),
        F.substring(F.col("account_no").cast("string"), 15, 16).alias("group_id"),
    )


@query(
    "string_split_name",
    "SELECT account_no, as_of, substring(res_name, position(',' IN res_name) + 1) AS first_name,"
    " CASE WHEN position(',' IN res_name) > 0 THEN substring(res_name, 1, position(',' IN res_name) - 1) ELSE '' END AS last_name FROM csr",
)
def _(t):
    return t.csr.select(
        "account_no", "as_of", text.first_name("res_name").alias("first_name"), text.last_name("res_name").alias("last_name")
    )


@query(
    "string_concat",
    "SELECT account_no, as_of, 't' || CAST(account_no AS VARCHAR) AS t_account, home_phone || '/' || bus_phone AS phones FROM csr",
)
def _(t):
    return t.csr.select(
        "account_no",
        "as_of",
        keys.prefixed_account("account_no", "t").alias("t_account"),
        F.concat("home_phone", F.lit("/"), "bus_phone").alias("phones"),
    )


@query("string_replace", "SELECT account, dt, replace(account_status, 'TFS', 'T') AS status FROM dna")
def _(t):
    return t.dna.select("account", "dt", F.replace("account_status", F.lit("TFS"), F.lit("T")).alias("status"))


@query(
    "regex_extract_number",
    "SELECT rec_id, CAST(trim(regexp_replace(CASE WHEN new_speed = '1 Giga' THEN '1000 Megas' ELSE new_speed END, '[^0-9 ]', '', 'g')) AS INT)"
    " - CAST(trim(regexp_replace(old_speed, '[^0-9 ]', '', 'g')) AS INT) AS speed_dif FROM email_recommendations",
)
def _(t):
    return t.email_recommendations.select(
        "rec_id", (text.speed_mbps("new_speed") - text.speed_mbps("old_speed")).alias("speed_dif")
    )


@query(
    "regex_match",
    "SELECT call_id, regexp_matches(lower(disposition), 'ofiti.+cliente.+acepta') AS contacted,"
    " regexp_matches(lower(disposition), 'ofiti.+cliente.acepta') AS accepted FROM call_feedback",
)
def _(t):
    return t.call_feedback.select(
        "call_id",
        text.matches("disposition", at.CONTACT_PATTERN).alias("contacted"),
        text.matches("disposition", at.ACCEPT_PATTERN).alias("accepted"),
    )


@query(
    "regex_count",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, ',')) AS INT) + 1 AS parts FROM documents",
)
def _(t):
    return t.documents.select("doc_id", (F.regexp_count("text", F.lit(",")) + 1).alias("parts"))


@query("string_length", "SELECT doc_id, CAST(length(text) AS INT) AS chars FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("chars"))


@query("coalesce_first", "SELECT account, dt, coalesce(bb_product, tv_product, vo_product) AS plan FROM dna")
def _(t):
    return t.dna.select("account", "dt", F.coalesce("bb_product", "tv_product", "vo_product").alias("plan"))


@query(
    "first_valid_id",
    "SELECT attempt_id, CASE "
    + " ".join(
        f"WHEN length(field_{i}) = 12 AND TRY_CAST(field_{i} AS BIGINT) > 0 THEN field_{i}" for i in DIALER_FIELDS
    )
    + " END AS account FROM dialer_attempts",
)
def _(t):
    return t.dialer_attempts.select(
        "attempt_id", keys.first_valid_id([f"field_{i}" for i in DIALER_FIELDS]).alias("account")
    )


@query(
    "cast",
    "SELECT email_id, CAST(account AS BIGINT) AS account_no, CAST(total_clicks AS DOUBLE) AS clicks FROM email_feedback",
)
def _(t):
    return t.email_feedback.select(
        "email_id",
        F.col("account").cast("bigint").alias("account_no"),
        F.col("total_clicks").cast("double").alias("clicks"),
    )


@query(
    "try_cast",
    "SELECT attempt_id, TRY_CAST(field_1 AS BIGINT) AS field_1, TRY_CAST(field_8 AS BIGINT) AS field_8 FROM dialer_attempts",
)
def _(t):
    return t.dialer_attempts.select(
        "attempt_id", keys.normalize_key("field_1").alias("field_1"), keys.normalize_key("field_8").alias("field_8")
    )


@query("math_round", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS seventh FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 7, 2).alias("seventh"))


@query(
    "math_floor_div",
    "SELECT comm_id, sent_ms // 1000 AS sent_seconds, CAST(floor(sent_ms / 86400000) AS BIGINT) AS sent_day FROM comms_history",
)
def _(t):
    return t.comms_history.select(
        "comm_id",
        F.expr("sent_ms div 1000").alias("sent_seconds"),
        F.floor(F.col("sent_ms") / 86_400_000).alias("sent_day"),
    )


@query(
    "arith_price",
    "SELECT account_no, total_charge + 5 AS with_dvr, (total_charge * 12 - 15) / 12 AS net FROM customer_profile",
)
def _(t):
    price = F.col("total_charge")
    return t.customer_profile.select(
        "account_no", (price + 5).alias("with_dvr"), ((price * 12 - 15) / 12).alias("net")
    )


@query(
    "date_extract",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS order_year, CAST(month(o_orderdate) AS INT) AS order_month,"
    " CAST(day(o_orderdate) AS INT) AS order_day FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"),
        F.dayofmonth("o_orderdate").alias("order_day"),
    )


@query(
    "date_trunc_month",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", d.month_start("o_orderdate").alias("order_month"))


@query("date_trunc_day", "SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS event_day FROM events")
def _(t):
    return t.events.select("event_id", F.col("ts").cast("date").alias("event_day"))


@query(
    "date_add_days",
    "SELECT order_no, order_date + 30 AS plus_30, order_date - 42 AS minus_42 FROM orders_activity",
)
def _(t):
    return t.orders_activity.select(
        "order_no", F.date_add("order_date", 30).alias("plus_30"), F.date_sub("order_date", 42).alias("minus_42")
    )


@query(
    "date_add_months",
    "SELECT order_no, CAST(order_date - INTERVAL 3 MONTH AS DATE) AS minus_3, CAST(CASE WHEN order_date = last_day(order_date)"
    " THEN last_day(CAST(order_date + INTERVAL 1 MONTH AS DATE)) ELSE order_date + INTERVAL 1 MONTH END AS DATE) AS plus_1_sticky"
    " FROM orders_activity",
)
def _(t):
    return t.orders_activity.select(
        "order_no",
        F.add_months("order_date", -3).alias("minus_3"),
        d.add_months_sticky("order_date", 1).alias("plus_1_sticky"),
    )


@query(
    "date_diff_days",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS days"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d.days_between("o_orderdate", "l_shipdate").alias("days")
    )


@query(
    "date_diff_months",
    "SELECT account_no, dt, CAST(date_sub('month', start_date, dt) AS INT) AS months FROM monthly_snapshot",
)
def _(t):
    return t.monthly_snapshot.select("account_no", "dt", d.complete_months("start_date", "dt").alias("months"))


@query(
    "date_parse_formats",
    "SELECT call_id, CAST(try_strptime(dial_text, '%m/%d/%Y') AS DATE) AS dialled FROM call_feedback",
)
def _(t):
    return t.call_feedback.select("call_id", d.parse_date("dial_text", "M/d/yyyy").alias("dialled"))


@query(
    "date_parse_clock",
    "SELECT attempt_id, CAST(strptime(replace(call_text, '.', ''), '%d/%m/%Y %I:%M:%S %p') AS DATE) AS called_on,"
    " CAST(hour(strptime(replace(call_text, '.', ''), '%d/%m/%Y %I:%M:%S %p')) AS INT) AS called_hour FROM dialer_attempts",
)
def _(t):
    at_time = d.parse_clock_text("call_text")
    return t.dialer_attempts.select(
        "attempt_id", at_time.cast("date").alias("called_on"), F.hour(at_time).alias("called_hour")
    )


@query(
    "date_parse_yyyymmdd",
    "SELECT email_id, CAST(strptime(substring(date_sent, 1, 8), '%Y%m%d') AS DATE) AS sent,"
    " CAST(strptime(date_opened, '%Y%m%d') AS DATE) AS opened FROM email_feedback",
)
def _(t):
    return t.email_feedback.select(
        "email_id", d.parse_yyyymmdd("date_sent").alias("sent"), d.parse_yyyymmdd("date_opened").alias("opened")
    )


@query("date_from_epoch_ms", f"SELECT comm_id, {day_of('contact_ms')} AS contact_date FROM comms_history")
def _(t):
    return t.comms_history.select("comm_id", d.epoch_ms_to_date("contact_ms").alias("contact_date"))


@query(
    "date_to_epoch",
    "SELECT order_no, CAST(epoch(order_date) AS BIGINT) AS seconds, epoch_ms(CAST(order_date AS TIMESTAMP)) AS millis FROM orders_activity",
)
def _(t):
    return t.orders_activity.select(
        "order_no", d.date_to_epoch_seconds("order_date").alias("seconds"), d.date_to_epoch_ms("order_date").alias("millis")
    )


@query("to_char_pad", "SELECT account_no, as_of, lpad(CAST(cycle_day AS VARCHAR), 2, '0') AS cycle_text FROM csr")
def _(t):
    return t.csr.select("account_no", "as_of", text.two_digits("cycle_day").alias("cycle_text"))


@query(
    "array_ops",
    "SELECT account, array_to_string(list_sort(list(category)), ',') AS categories, count(category) AS entries FROM exclusions GROUP BY 1",
)
def _(t):
    folded = fold_strings(t.exclusions, ["account"], "category", "categories", lower=False)
    return folded.select("account", "categories", "entries")


@query(
    "multiset_counts",
    "SELECT account, lower(category) AS category, count(*) AS n FROM exclusions WHERE category IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    return multiset(t.exclusions, ["account"], F.lower("category"), "category")


fragment("latest_csr", "SELECT * FROM csr WHERE as_of = (SELECT max(as_of) FROM csr)")


@query("count_distinct_global", "SELECT count(DISTINCT account_no) AS accounts FROM latest_csr")
def _(t):
    return count_distinct(sn.latest_snapshot(t.csr, "as_of"), [], "account_no", "accounts")
