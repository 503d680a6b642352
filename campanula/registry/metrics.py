"""Base, tenure, delinquency and churn metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from campanula.plans import retention as rt
from campanula.registry.base import fragment, query

fragment(
    "active_2024",
    "SELECT account_no, dt FROM daily_activity WHERE dt BETWEEN DATE '2024-01-01' AND DATE '2024-12-31'"
    " AND customer_type = 'Residencial' AND outstanding_age < 90",
)
fragment(
    "unpaid",
    "SELECT account_no, dt, CAST(date_diff('day', CAST(strptime(substring(oldest_unpaid, 1, 8), '%Y%m%d') AS DATE), dt) AS INT) AS days_overdue"
    " FROM monthly_snapshot",
)
fragment("activity_classes", "SELECT *, CASE WHEN days_overdue >= 90 THEN 'Inactivos' ELSE 'Activos' END AS activity FROM unpaid")


@query(
    "monthly_active_accounts",
    "SELECT CAST(year(dt) AS INT) AS year, CAST(month(dt) AS INT) AS month, count(DISTINCT account_no) AS accounts FROM monthly_snapshot GROUP BY 1, 2",
)
def _(t):
    return rt.monthly_active_accounts(t.monthly_snapshot)


@query(
    "monthly_active_first_days",
    "SELECT CAST(year(dt) AS INT) AS year, CAST(month(dt) AS INT) AS month, count(DISTINCT account_no) AS accounts FROM monthly_snapshot"
    " WHERE day(dt) = 1 AND year(dt) = 1998 GROUP BY 1, 2",
)
def _(t):
    return rt.monthly_active_accounts(t.monthly_snapshot, 1998, first_day_only=True)


@query(
    "first_day_per_month",
    "SELECT CAST(month(dt) AS INT) AS month, CAST(min(day(dt)) AS INT) AS first_day, count(DISTINCT account_no) AS accounts FROM monthly_snapshot"
    " WHERE year(dt) = 1998 GROUP BY 1",
)
def _(t):
    return rt.first_day_per_month(t.monthly_snapshot, 1998)


@query(
    "orders_by_month",
    "SELECT CAST(month(order_start) AS INT) AS month, count(DISTINCT order_id) AS orders FROM service_orders"
    " WHERE account_type = 'Residential' AND year(order_start) = 2022 GROUP BY 1",
)
def _(t):
    return rt.orders_by_month(t.service_orders, 2022)


@query(
    "interactions_by_type",
    "SELECT purpose, count(DISTINCT interaction_id) AS interactions FROM interactions WHERE year(start_date) = 2024 AND month(start_date) = 1 GROUP BY 1",
)
def _(t):
    return rt.interactions_by_type(t.interactions, "2024-01-01", "2024-01-31")


TENURE = (
    "SELECT dt, CASE WHEN date_sub('month', start_date, dt) < 6 THEN 'early tenure' WHEN date_sub('month', start_date, dt) <= 12"
    " THEN 'mid tenure' ELSE 'late tenure' END AS tenure_class, count(DISTINCT account_no) AS accounts FROM monthly_snapshot"
    " WHERE day(dt) = 1 GROUP BY 1, 2"
)
fragment("tenure_counts", TENURE)


@query("tenure_class_counts", TENURE)
def _(t):
    return rt.tenure_class_counts(t.monthly_snapshot)


@query("tenure_class_totals", "SELECT dt, CAST(sum(accounts) AS BIGINT) AS accounts FROM tenure_counts GROUP BY 1")
def _(t):
    return rt.tenure_class_totals(t.monthly_snapshot)


@query("delinquency_days", "SELECT account_no, dt, days_overdue, activity FROM activity_classes")
def _(t):
    return rt.delinquency_days(t.monthly_snapshot)


@query("active_inactive_counts", "SELECT activity, count(DISTINCT account_no) AS accounts FROM activity_classes GROUP BY 1")
def _(t):
    return rt.active_inactive_counts(t.monthly_snapshot)


@query(
    "active_then_deactivated",
    "SELECT CAST(date_trunc('month', a.dt) AS DATE) AS month, count(DISTINCT a.account_no) AS accounts FROM"
    " (SELECT account_no, dt + 8217 AS dt FROM activity_classes WHERE activity = 'Activos') a"
    " JOIN service_orders s ON a.account_no = s.account_no AND s.order_type = 'DEACTIVATION'"
    " AND date_trunc('month', s.order_start) = date_trunc('month', a.dt) GROUP BY 1",
)
def _(t):
    # the snapshots' dates are moved like the orders' so that the months meet
    moved = t.monthly_snapshot.withColumns(
        {
            "oldest_unpaid": F.date_format(
                F.date_add(F.to_date(F.substring("oldest_unpaid", 1, 8), "yyyyMMdd"), 8217), "yyyyMMdd"
            ),
            "dt": F.date_add("dt", 8217),
        }
    )
    return rt.active_then_deactivated(moved, t.service_orders)


@query(
    "active_base",
    "SELECT account_no, dt, outstanding_age FROM daily_activity WHERE year(dt) = 2024 AND customer_type = 'Residencial' AND outstanding_age < 90",
)
def _(t):
    return rt.active_base(t.daily_activity, 2024).select("account_no", "dt", "outstanding_age")


@query(
    "repeat_callers",
    "WITH calls AS (SELECT a.account_no, date_trunc('month', a.dt) AS month, count(DISTINCT i.interaction_id) AS n FROM active_2024 a"
    " JOIN interactions i ON a.account_no = i.account_no AND i.purpose = 'CLAIM'"
    " AND date_trunc('month', i.start_date) = date_trunc('month', a.dt) GROUP BY 1, 2)"
    " SELECT CAST(month AS DATE) AS month, CASE WHEN n = 1 THEN 'Single Callers' ELSE 'Repeated Callers' END AS category,"
    " count(DISTINCT account_no) AS accounts FROM calls GROUP BY 1, 2",
)
def _(t):
    claims = t.interactions.where(F.col("purpose") == "CLAIM")
    return rt.repeat_callers(rt.active_base(t.daily_activity, 2024), claims)


@query(
    "last_seen_churn",
    "SELECT last_seen, count(*) AS accounts FROM (SELECT account_no, max(dt) AS last_seen FROM active_2024 GROUP BY 1)"
    " WHERE month(last_seen) IN (1, 2) GROUP BY 1",
)
def _(t):
    return rt.last_seen_churn(rt.active_base(t.daily_activity, 2024), "2024-01-01", "2024-02-29")


@query(
    "reactivation_gaps",
    "SELECT dt, count(DISTINCT account_no) AS accounts FROM (SELECT account_no, dt, lag(dt) OVER (PARTITION BY account_no ORDER BY dt) AS previous"
    " FROM (SELECT DISTINCT account_no, dt FROM active_2024)) WHERE dt - previous > 1 GROUP BY 1",
)
def _(t):
    return rt.reactivation_gaps(rt.active_base(t.daily_activity, 2024))


@query(
    "interaction_then_disconnect",
    "SELECT count(DISTINCT i.account_no) AS accounts FROM interactions i JOIN service_orders s ON i.account_no = s.account_no"
    " AND s.order_type = 'DEACTIVATION' AND date_diff('day', i.start_date, s.order_start) BETWEEN 0 AND 40"
    " WHERE i.account_no IN (SELECT account_no FROM active_2024)",
)
def _(t):
    return rt.interaction_then_disconnect(rt.active_base(t.daily_activity, 2024), t.interactions, t.service_orders)


@query(
    "users_with_interaction",
    "SELECT CAST(date_trunc('month', dt) AS DATE) AS month, 'TRUCKROLL' AS purpose, count(DISTINCT f.account_no) AS accounts FROM monthly_snapshot f"
    " LEFT JOIN interactions i ON i.account_no = f.account_no WHERE i.purpose = 'TRUCKROLL' AND bb_prod IS NOT NULL AND day(dt) = 1 GROUP BY 1",
)
def _(t):
    return rt.users_with_interaction(t.monthly_snapshot, t.interactions, "TRUCKROLL")


@query(
    "users_with_orders_and_interactions",
    "SELECT CAST(date_trunc('month', f.dt) AS DATE) AS month, count(DISTINCT f.account_no) AS accounts FROM monthly_snapshot f"
    " JOIN (SELECT DISTINCT account_no FROM service_orders) s ON f.account_no = s.account_no"
    " JOIN (SELECT DISTINCT account_no FROM interactions) i ON f.account_no = i.account_no WHERE day(f.dt) = 1 GROUP BY 1",
)
def _(t):
    return rt.users_with_orders_and_interactions(t.monthly_snapshot, t.service_orders, t.interactions)
