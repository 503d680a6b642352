"""Logical campaign tables derived from the star-schema test tables.

Each logical table is one projection of a physical table (or of a key join of
two), written as expressions that mean the same in Spark SQL and in the SQL
used for checking, so both sides start from identical input.  Everything is
computed from the rows that are there: the derived tables grow with them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = "2024-01-31"
AS_OF_DAY = 19753  # AS_OF in days since 1970-01-01
ORDER_SHIFT = 8217  # moves the last order date to the day before AS_OF
ACCOUNT_BASE = 8211000000000000  # 16-digit account numbers
_DAY_MS = 86_400_000


def _pkg(k: str) -> str:
    """Five-character package code: drop letter, product mask, series."""
    return (
        f"(CASE ({k}) % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'F' ELSE 'H' END"
        f" || CAST(({k}) % 8 AS STRING) || 'J' || CAST(({k}) % 5 AS STRING) || 'F')"
    )


def _day_ms(offset: str) -> str:
    """Midnight of AS_OF plus an offset in days, as epoch milliseconds."""
    return f"({AS_OF_DAY} + ({offset})) * CAST({_DAY_MS} AS BIGINT)"


def _account(key: str) -> str:
    return f"{ACCOUNT_BASE} + {key}"


def _campaign_account(key: str) -> str:
    """Twelve-digit account id whose middle digits vary with the key."""
    return f"CAST(310000000000 + ({key} * 1000003) % 90000000000 AS STRING)"


def _bundles(k: str) -> dict[str, str]:
    code = _pkg(k)
    return {
        "cable_up": f"CASE WHEN {k} % 5 = 0 THEN ' ' ELSE {code} || '-TV' END",
        "internet_up": f"CASE WHEN {k} % 7 = 0 THEN ' ' WHEN {k} % 11 = 0 THEN {_pkg(k + ' + 1')}"
        f" ELSE {code} || '-HS' END",
        "phone_up": f"CASE WHEN {k} % 3 = 0 THEN ' ' WHEN {k} % 13 = 0 THEN NULL ELSE {code} END",
        "cable_down": f"CASE WHEN {k} % 4 = 0 THEN ' ' ELSE {_pkg(k + ' + 7')} END",
        "internet_down": f"{_pkg(k + ' + 7')}",
        "phone_down": f"CASE WHEN {k} % 6 = 0 THEN {_pkg(k + ' + 9')} ELSE ' ' END",
        "stb_sc": f"CASE WHEN {k} % 4 = 0 THEN 'HD-DVR BOX' WHEN {k} % 4 = 1 THEN 'STB' END",
    }


@dataclass(frozen=True)
class Logical:
    source: str
    columns: dict[str, str]
    join: tuple[str, str, str] | None = None  # (table, left key, right key)
    copies: int = 0  # one row per n in 0..copies-1 when > 0
    where: str | None = None


_EVENT_DATE = "CAST(ts AS DATE)"
_EVENT_YMD = "(year({d}) * 10000 + month({d}) * 100 + day({d}))"

LOGICAL: dict[str, Logical] = {
    # account x day, three daily snapshots
    "csr": Logical(
        "customer",
        copies=3,
        columns={
            "account_no": _account("c_custkey"),
            "account_id": f"'ACCT_FX_' || CAST({_account('c_custkey')} AS STRING)",
            "as_of": f"CAST('{AS_OF}' AS DATE) - n",
            "as_of_ms": _day_ms("-n"),
            "welcome_offer": "CASE WHEN c_custkey % 11 = 0 THEN 'X' END",
            "acp": "CASE WHEN c_custkey % 13 = 0 THEN 'X' WHEN c_custkey % 13 = 1 THEN '' END",
            "joint_customer": "CASE WHEN c_custkey % 17 = 0 THEN 'X' END",
            "bill_code": _pkg("c_custkey + (CASE WHEN c_custkey % 6 = 0 THEN n ELSE 0 END)"),
            "addr1": "c_mktsegment || ' ST ' || CAST(c_custkey % 97 AS STRING)",
            "city": "'CITY_' || CAST(c_nationkey AS STRING)",
            "home_phone": "CASE WHEN c_custkey % 19 = 0 THEN NULL"
            " WHEN c_custkey % 5 = 0 THEN '787' || CAST(c_nationkey AS STRING)"
            " ELSE '939' || CAST(c_custkey AS STRING) END",
            "bus_phone": "CASE WHEN c_custkey % 3 = 0 THEN '787' || CAST(c_custkey AS STRING) END",
            "cycle_day": "CAST(1 + c_custkey % 31 AS INT)",
            "email": "CASE WHEN c_custkey % 7 <> 0 THEN lower(c_name) || '@example.com' END",
            "customer_type": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'COM' ELSE 'RES' END",
            "delinquency_days": "CAST((c_custkey * 7 + n) % 90 - 5 AS INT)",
            "hsd": "CAST(CASE WHEN c_custkey % 4 < 3 THEN 1 ELSE 0 END AS INT)",
            "hsd_speed": "CASE WHEN c_custkey % 6 = 0 THEN CAST(100 * (n + 1) AS STRING) ELSE '300' END",
            "res_name": "CASE WHEN c_custkey % 8 = 0 THEN c_name ELSE c_mktsegment || ',' || c_name END",
            "tenure": "CAST(c_custkey % 60 AS DOUBLE) / 12",
        },
    ),
    "account_flags": Logical(
        "customer",
        columns={
            "account_no": _account("c_custkey"),
            "has_privacy_flag": "CASE WHEN c_custkey % 9 = 0 THEN 'X' WHEN c_custkey % 9 = 1 THEN '' END",
            "has_open_order": "CASE WHEN c_custkey % 14 = 3 THEN 'X' END",
            "pending_tc": "CASE WHEN c_custkey % 15 = 4 THEN 'X' ELSE ' ' END",
            "is_in_ndnc": "CASE WHEN c_custkey % 6 = 5 THEN 'X' END",
        },
    ),
    "offers": Logical(
        "lineitem",
        join=("orders", "l_orderkey", "o_orderkey"),
        columns={
            "account_no": _account("o_custkey"),
            "offer_id": "l_orderkey",
            "pkg_cde": f"CASE WHEN l_suppkey % 4 = 0 THEN {_pkg('l_suppkey')} ELSE {_pkg('o_custkey')} END",
            "recommendedpkg": _pkg("l_partkey"),
            "channel": "CASE l_returnflag WHEN 'R' THEN 'Email' WHEN 'N' THEN 'Call Center' ELSE 'Retail' END",
            "offer_type": "CASE l_linestatus WHEN 'O' THEN 'Single' ELSE 'Multiple' END",
            "offer_rank": "l_linenumber",
            "regime": "CASE o_custkey % 5 WHEN 0 THEN 'control_x' WHEN 1 THEN 'control_j' ELSE 'offerfit' END",
            "reward": "l_tax * 10",
            "discount": "CAST(CASE WHEN l_discount >= 0.05 THEN 15 ELSE 0 END AS DOUBLE)",
            "delta_arpu": "l_extendedprice / 1000 - 40",
            "stb": "CASE l_suppkey % 3 WHEN 0 THEN 'HD-DVR' WHEN 1 THEN ' ' END",
            "time_frame": "CASE l_suppkey % 3 WHEN 0 THEN 'Afternoon' WHEN 1 THEN 'Morning' END",
            "hsd_service": "CASE WHEN l_suppkey % 5 <> 0 THEN CAST(100 * (l_suppkey % 4) AS STRING) || ' Megas' END",
            "to_speed_name": "CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey % 900 AS STRING) || ' Megas' END",
            "next_best_action_date": f"CAST('{AS_OF}' AS DATE) - CAST(l_partkey % 8 AS INT)",
            "next_best_action_ms": "CASE WHEN l_suppkey % 7 <> 0 THEN " + _day_ms("- (l_partkey % 8)") + " END",
            "recommended_ms": _day_ms("- (l_partkey % 40)"),
            "param_1": "CAST(l_suppkey % 3 AS STRING)",
            "param_2": "CASE WHEN l_suppkey % 2 = 0 THEN 'Mensaje ' || CAST(l_suppkey AS STRING) END",
            "param_3": "CASE WHEN l_suppkey % 4 = 1 THEN 'Si deseas el plan' ELSE 'Llama ya' END",
            "param_4": "CASE WHEN l_suppkey % 5 = 2 THEN 'Mas Velocidad hoy' ELSE 'Oferta' END",
            "link": "CASE WHEN l_suppkey % 10 <> 0 THEN 'https://example.com/o/' || CAST(l_orderkey AS STRING) END",
            "link_ms": _day_ms("- (l_partkey % 20)"),
            "link_exp_ms": _day_ms("l_suppkey % 20"),
        },
    ),
    # plan-change orders of every customer, dates moved next to AS_OF
    "orders_activity": Logical(
        "orders",
        columns={
            "account_no": _account("o_custkey"),
            "order_no": "o_orderkey",
            "order_date": f"CAST(o_orderdate AS DATE) + {ORDER_SHIFT}",
            "ord_typ": "CASE o_orderpriority WHEN '1-URGENT' THEN 'UPGRADE' WHEN '2-HIGH' THEN 'DOWNGRADE'"
            " WHEN '3-MEDIUM' THEN 'SIDEGRADE' WHEN '5-LOW' THEN 'NON PAY'"
            " ELSE (CASE WHEN o_orderkey % 2 = 0 THEN 'CONNECT' ELSE 'V_DISCO' END) END",
            "salesrep_area": "CASE o_orderstatus WHEN 'F' THEN 'C2MAX SALES' WHEN 'O' THEN 'CALLCENTER' ELSE 'WALK IN' END",
            "month_amount": "o_totalprice / 1000",
            "before_amount": "o_totalprice / 1100",
            **_bundles("o_orderkey"),
        },
    ),
    # the same columns from purchase events, for the dashboards
    "purchase_orders": Logical(
        "events",
        where="event_type = 'purchase'",
        columns={
            "account_no": _account("user_id"),
            "order_no": "event_id",
            "order_ts": "ts",
            "order_date": _EVENT_DATE,
            "ord_typ": "CASE event_id % 9 WHEN 0 THEN 'CONNECT' WHEN 1 THEN 'NON PAY' WHEN 2 THEN 'DOWNGRADE'"
            " WHEN 3 THEN 'RESTART' ELSE 'UPGRADE' END",
            "salesrep_area": "CASE event_id % 6 WHEN 0 THEN 'TELEPERFORMANCE CSR' WHEN 1 THEN 'Retention'"
            " WHEN 2 THEN 'VOIP ENG CSSR' WHEN 3 THEN 'OUTBOUND X PROJECT' WHEN 4 THEN 'Pre Retention' ELSE 'WALK IN' END",
            **_bundles("event_id"),
        },
    ),
    "service_orders": Logical(
        "orders",
        columns={
            "account_no": _account("o_custkey"),
            "campaign_account": _campaign_account("o_custkey"),
            "order_id": "o_orderkey",
            "order_start": f"CAST(o_orderdate AS DATE) + {ORDER_SHIFT}",
            "order_type": "CASE o_orderkey % 4 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'DEACTIVATION'"
            " WHEN 2 THEN 'INSTALLATION' ELSE 'TRANSFER' END",
            "order_status": "CASE o_orderstatus WHEN 'P' THEN 'PENDING' ELSE 'COMPLETED' END",
            "account_type": "CASE WHEN o_custkey % 10 = 0 THEN 'Business' ELSE 'Residential' END",
            "network_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'HFC' ELSE 'FTTH' END",
            "lob_vo_count": "CAST(o_orderkey % 2 AS INT)",
            "lob_bb_count": "CAST(o_orderkey % 3 AS INT)",
            "lob_tv_count": "CAST(o_orderkey % 5 AS INT)",
            "sales_rep_name": "CASE o_orderkey % 3 WHEN 0 THEN 'Rob B' WHEN 1 THEN 'Ruth Quiros' ELSE 'D Gomez' END",
            "channel_type": "CASE WHEN o_orderkey % 5 < 3 THEN 'AC19 auto' ELSE 'Shop' END",
        },
    ),
    "interactions": Logical(
        "events",
        columns={
            "account_no": _account("user_id"),
            "campaign_account": _campaign_account("user_id"),
            "interaction_id": "user_id * 1000 + event_id % 40",
            "event_id": "event_id",
            "start_ts": "ts",
            "start_date": _EVENT_DATE,
            "purpose": "CASE event_type WHEN 'error' THEN 'TICKET' WHEN 'click' THEN 'TRUCKROLL'"
            " WHEN 'view' THEN 'CLAIM' ELSE 'INQUIRY' END",
            "status": "CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'CLOSED' ELSE 'WORKING' END",
            "channel": "CASE event_id % 5 WHEN 0 THEN 'C2MAX CSR' WHEN 1 THEN 'Retention' WHEN 2 THEN 'OUTBOUND A PROJECT'"
            " WHEN 3 THEN 'WEB' ELSE 'LivePerson' END",
            "info": "CASE event_id % 4 WHEN 0 THEN 'Phone in' WHEN 1 THEN 'Contact  Center' WHEN 2 THEN 'chat' ELSE 'PHONE' END",
        },
    ),
    # account x day from activity, with the natural gaps between days
    "daily_activity": Logical(
        "events",
        columns={
            "account_no": _account("user_id"),
            "dt": _EVENT_DATE,
            "outstanding_age": "CAST((user_id * 3) % 120 AS INT)",
            "customer_type": "CASE WHEN user_id % 10 = 0 THEN 'Comercial' ELSE 'Residencial' END",
            "event_id": "event_id",
        },
    ),
    # account x month snapshots from orders
    "monthly_snapshot": Logical(
        "orders",
        join=("customer", "o_custkey", "c_custkey"),
        columns={
            "account_no": _account("o_custkey"),
            "dt": "CAST(o_orderdate AS DATE)",
            "start_date": "CAST('1994-06-15' AS DATE) + CAST((o_custkey * 37) % 2400 AS INT)",
            "customer_type": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Comercial' ELSE 'Residencial' END",
            "bb_prod": "CASE WHEN o_custkey % 8 <> 0 THEN 'BB' || CAST(o_custkey % 5 AS STRING) END",
            "oldest_unpaid": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST("
            + _EVENT_YMD.format(d="(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 180 AS INT))")
            + " AS STRING) || '000000' END",
        },
    ),
    "recommendations": Logical(
        "events",
        where="event_type = 'view'",
        columns={
            "account_no": _account("user_id"),
            "rec_id": "event_id",
            "date_text": f"CASE WHEN event_id % 23 = 0 THEN '0' ELSE CAST({_EVENT_DATE} AS STRING) || ' 00:00' END",
            "pkg_cde": _pkg("user_id"),
            "recommendedpkg": _pkg("event_id + user_id"),
            "stb": "CASE WHEN event_id % 4 = 0 THEN 'HD-DVR' WHEN event_id % 4 = 1 THEN ' ' END",
        },
    ),
    "email_recommendations": Logical(
        "events",
        where="event_type = 'signup'",
        columns={
            "account_no": _account("user_id"),
            "rec_id": "event_id",
            "rec_date": _EVENT_DATE,
            "regime": "CASE user_id % 5 WHEN 0 THEN 'control_x' WHEN 1 THEN 'control_j' ELSE 'offerfit' END",
            "from_code": _pkg("user_id"),
            "to_code": _pkg("event_id"),
            "payment_dif": "CAST(event_id % 30 AS STRING)",
            "discount": "CAST(CASE WHEN event_id % 3 = 0 THEN 15 ELSE 0 END AS DOUBLE)",
            "old_speed": "CAST(50 * (1 + user_id % 6) AS STRING) || ' Megas'",
            "new_speed": "CASE WHEN event_id % 5 = 0 THEN '1 Giga' ELSE CAST(100 * (1 + event_id % 6) AS STRING) || ' Megas' END",
            "stb": "CASE WHEN event_id % 4 = 0 THEN 'HD-DVR' END",
        },
    ),
    "email_feedback": Logical(
        "events",
        where="event_type = 'signup'",
        columns={
            "account": f"CAST({_account('user_id')} AS STRING)",
            "email_id": "event_id",
            "campaign_title": "'CMP_' || CAST(event_id % 6 AS STRING)",
            "total_clicks": "CAST(event_id % 4 AS INT)",
            "date_sent": "CAST("
            + _EVENT_YMD.format(d=f"({_EVENT_DATE} + CAST(event_id % 3 AS INT))")
            + " AS STRING) || '0800'",
            "date_opened": "CASE WHEN event_id % 2 = 0 THEN CAST("
            + _EVENT_YMD.format(d=f"({_EVENT_DATE} + 2)")
            + " AS STRING) END",
            "date_clicked": "CASE WHEN event_id % 4 = 0 THEN CAST("
            + _EVENT_YMD.format(d=f"({_EVENT_DATE} + 2)")
            + " AS STRING) END",
            "extracted": "CAST(20240201 + CAST(event_id % 2 AS INT) AS STRING)",
            "dt": "CASE WHEN event_id % 13 < 6 THEN '2024-02-01' ELSE '2024-02-02' END",
        },
    ),
    "call_feedback": Logical(
        "events",
        where="event_type = 'error'",
        columns={
            "cuenta": f"CAST({_account('user_id')} AS STRING)",
            "call_id": "event_id",
            "dial_text": "CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(month(ts) AS STRING) || '/' ||"
            " CAST(day(ts) AS STRING) || '/' || CAST(year(ts) AS STRING) END",
            "disposition": "CASE event_id % 4 WHEN 0 THEN 'Ofitizado cliente SI acepta' WHEN 1 THEN 'Ofiti - Cliente acepta'"
            " WHEN 2 THEN 'No contesta' ELSE 'Cliente no acepta' END",
            "comments": "CASE WHEN event_id % 2 = 0 THEN 'c' || CAST(event_id % 100 AS STRING) END",
            "not_offered": "CASE WHEN event_id % 9 <> 0 THEN event_id % 5 < 2 END",
            "not_attended": "CASE WHEN event_id % 8 <> 0 THEN event_id % 4 = 2 OR event_id % 7 = 0 END",
        },
    ),
    "comms_history": Logical(
        "events",
        columns={
            "account_no": _account("user_id"),
            "comm_id": "event_id",
            "channel": "CASE WHEN event_id % 5 < 3 THEN 'email' ELSE 'outbound_call' END",
            "campaign": "CASE event_id % 3 WHEN 0 THEN 'UPSELL_TARGET' WHEN 1 THEN 'UPSELL_CONTROL' ELSE 'RETENTION' END",
            "use_case": "event_type",
            "comm_date": _EVENT_DATE,
            "sent_ms": "epoch_ms(ts)",
            "contact_ms": "CASE WHEN event_id % 4 <> 0 THEN epoch_ms(ts) + CAST(3600000 AS BIGINT) * (event_id % 90) END",
            "conv_ms": "CASE WHEN event_id % 6 = 0 THEN epoch_ms(ts) + CAST(86400000 AS BIGINT) * (event_id % 12) END",
            "rec_ms": "epoch_ms(ts) - CAST(86400000 AS BIGINT) * (event_id % 5)",
            "conv_type": "CASE WHEN event_id % 6 = 0 THEN 'upgrade' END",
            "order_id": "CASE WHEN event_id % 6 = 0 THEN event_id END",
            "conv_flg": "event_id % 6 = 0",
            "open_date": f"CASE WHEN event_id % 3 = 0 THEN {_EVENT_DATE} + 1 END",
        },
    ),
    "package_prices": Logical(
        "part",
        columns={
            "package_code": _pkg("p_partkey"),
            "part_key": "p_partkey",
            "description": "p_name",
            "price": "p_retailprice / 10",
        },
    ),
    "front_book": Logical(
        "part",
        columns={
            "package_code": _pkg("p_partkey * 3"),
            "front_key": "p_partkey",
            "connection": "CASE WHEN p_partkey % 2 = 0 THEN 'Coax Trad' ELSE 'FTTH' END",
            "play": "CASE WHEN p_size % 3 = 0 THEN '3P' WHEN p_size % 3 = 1 THEN '2P' ELSE '1P' END",
            "tv": "CASE p_partkey % 5 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Choice Pack' WHEN 2 THEN 'Ultimate' WHEN 3 THEN 'UPICK' END",
            "phone": "CASE WHEN p_size % 4 <> 1 THEN 'Y' END",
            "modem": "CASE WHEN p_size % 7 <> 1 THEN 'Y' END",
            "price": "p_retailprice",
            "speed": "CAST(p_size AS INT)",
        },
    ),
    "assets": Logical(
        "part",
        copies=2,
        columns={
            "package_code": _pkg("p_partkey"),
            "dt": f"CAST('{AS_OF}' AS DATE) - (n + CAST(p_partkey % 3 AS INT))",
            "charge": "p_retailprice",
        },
    ),
    "customer_profile": Logical(
        "customer",
        columns={
            "account_no": _account("c_custkey"),
            "drop_type": "CASE WHEN c_custkey % 2 = 0 THEN 'COAX' ELSE 'FIBER' END",
            "play_type": "CASE c_custkey % 5 WHEN 0 THEN '3P Video HSD Voice' WHEN 1 THEN '2P HSD Voice'"
            " WHEN 2 THEN '2P Video Voice' WHEN 3 THEN '2P Video HSD ' ELSE '1P Video ' END",
            "stb_sc": "CASE WHEN c_custkey % 3 = 0 THEN 'HD-DVR' ELSE 'STB' END",
            "video_service": "CASE c_nationkey % 6 WHEN 0 THEN 'BASIC' WHEN 1 THEN 'CHOICE PACK' WHEN 2 THEN 'ULTIMATE'"
            " WHEN 3 THEN 'UPICK' WHEN 4 THEN 'ESP PRIMERA' ELSE 'OTHER' END",
            "total_charge": "900 + c_acctbal / 200",
            "package_code": _pkg("c_custkey"),
            "down_speed": "CAST(c_custkey % 40 AS INT)",
        },
    ),
    "service_calls": Logical(
        "events",
        columns={
            "account_no": _account("user_id"),
            "call_id": "event_id",
            "call_date": _EVENT_DATE,
            "service": "CASE event_type WHEN 'error' THEN 'Tier2' WHEN 'click' THEN 'CSR_SPA' WHEN 'view' THEN 'Sales_ENG' ELSE 'Other' END",
            "action": "CASE event_id % 3 WHEN 0 THEN 'Answered' WHEN 1 THEN 'Call Complete' ELSE 'Abandoned' END",
            "agent_area": "CASE event_id % 4 WHEN 0 THEN 'C2MAX SALES' WHEN 1 THEN 'LivePerson' WHEN 2 THEN 'NPS CLOSED LOOP' ELSE 'OTHER' END",
        },
    ),
    # ---- collections ----
    "dna": Logical(
        "customer",
        copies=2,
        columns={
            "account": _campaign_account("c_custkey"),
            "dt": f"CAST(CAST('{AS_OF}' AS DATE) - (n + 1) AS STRING)",
            "customer_type": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Comercial' ELSE 'Residencial' END",
            "mix": "CASE WHEN c_custkey % 12 = 0 THEN '0P' ELSE CAST(1 + c_custkey % 3 AS STRING) || 'P' END",
            "customer_name": "CASE WHEN c_custkey % 29 <> 0 THEN c_name END",
            "phone_1": "CASE WHEN c_custkey % 6 <> 0 THEN CAST(60000000 + c_custkey * 31 % 9999991 AS STRING) END",
            "phone_2": "CASE WHEN c_custkey % 4 = 1 THEN CAST(50000000 + c_custkey * 37 % 9999991 AS STRING) END",
            "phone_3": "CASE WHEN c_custkey % 10 = 3 THEN CAST(40000000 + c_custkey * 41 % 9999991 AS STRING) END",
            "email": "CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' END",
            "account_status": "CASE c_custkey % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'D' WHEN 2 THEN 'TFS' ELSE 'A' END",
            "cycle": "CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END",
            "outstanding_age": "CAST(c_custkey % 97 + 16 AS INT)",
            "overdue_age": "CAST(c_custkey % 97 - 4 AS INT)",
            "outstanding_amount": "c_acctbal",
            "due_m0": f"CASE WHEN c_custkey % 3 <> 0 THEN CAST('{AS_OF}' AS DATE) - CAST(c_custkey % 9 AS INT) + 3 END",
            "due_m1": f"CAST('{AS_OF}' AS DATE) - CAST(c_custkey % 40 AS INT)",
            "bill_m0": "round(c_acctbal / 3, 2)",
            "bill_m1": "round(c_acctbal / 5, 2)",
            "paid_m0": f"CASE WHEN c_custkey % 2 = 0 THEN CAST('{AS_OF}' AS DATE) - 10 END",
            "paid_m1": f"CASE WHEN c_custkey % 3 = 0 THEN CAST('{AS_OF}' AS DATE) - 40 END",
            "paid_m2": f"CASE WHEN c_custkey % 5 = 0 THEN CAST('{AS_OF}' AS DATE) - 70 END",
            "paid_m3": f"CASE WHEN c_custkey % 7 <> 0 THEN CAST('{AS_OF}' AS DATE) - 100 END",
            "bb_media": "CASE c_custkey % 4 WHEN 0 THEN 'FTTH' WHEN 1 THEN 'HFC' END",
            "tv_media": "CASE c_custkey % 3 WHEN 0 THEN 'HFC' WHEN 1 THEN 'FTTH' END",
            "vo_media": "CASE c_custkey % 5 WHEN 0 THEN 'HFC' WHEN 1 THEN 'FTTH' WHEN 2 THEN 'COPPER' END",
            "bb_product": "CASE WHEN c_custkey % 2 = 0 THEN 'BB ' || c_mktsegment END",
            "tv_product": "CASE WHEN c_custkey % 3 = 0 THEN 'TV postmora' END",
            "vo_product": "CASE WHEN c_custkey % 5 <> 0 THEN 'VO ' || c_mktsegment END",
        },
    ),
    "risk_scores": Logical(
        "customer",
        copies=2,
        columns={
            "account": _campaign_account("c_custkey"),
            "decile": "CAST(1 + (c_custkey + n) % 10 AS INT)",
            "score": "round(CAST(c_custkey % 1000 AS DOUBLE) / 1000, 3)",
            "week": f"CAST('{AS_OF}' AS DATE) - 7 * n",
        },
    ),
    "payments": Logical(
        "events",
        where="event_type = 'purchase'",
        columns={
            "account": _campaign_account("user_id"),
            "amount_text": "CAST(value AS STRING)",
            "created_text": f"CAST({_EVENT_DATE} AS STRING) || ' 08:30:15'",
        },
    ),
    "dialer_attempts": Logical(
        "events",
        where="event_type = 'click'",
        columns={
            "attempt_id": "event_id",
            **{
                f"field_{i}": (
                    f"CASE WHEN event_id % 12 + 1 = {i} THEN {_campaign_account('user_id')}"
                    f" WHEN event_id % 7 = {i % 7} THEN 'abcdefghijkl' WHEN event_id % 5 = {i % 5} THEN '12345678901' END"
                )
                for i in range(1, 13)
            },
            "outcome": "CASE event_id % 6 WHEN 0 THEN 'Success' WHEN 1 THEN 'Invalid' WHEN 2 THEN 'No Dial Tone'"
            " WHEN 3 THEN 'Numero Equivocado' WHEN 4 THEN 'No contesta' END",
            "child_outcome": "CASE event_id % 3 WHEN 0 THEN 'Buzon' WHEN 1 THEN 'Ocupado' END",
            "call_text": "lpad(CAST(day(ts) AS STRING), 2, '0') || '/' || lpad(CAST(month(ts) AS STRING), 2, '0') || '/' ||"
            " CAST(year(ts) AS STRING) || ' ' || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') || ':' ||"
            " lpad(CAST(minute(ts) AS STRING), 2, '0') || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0')"
            " || CASE WHEN event_id % 2 = 0 THEN ' a.m.' ELSE ' p.m.' END",
        },
    ),
    "dialer_history": Logical(
        "events",
        columns={
            "field_1": f"CASE WHEN event_id % 3 <> 0 THEN {_campaign_account('user_id')} END",
            "field_2": f"CASE WHEN event_id % 3 = 0 THEN {_campaign_account('user_id')} END",
            "child_outcome": "CASE WHEN event_id % 4 < 2 THEN 'No contesta1' WHEN event_id % 4 = 2 THEN 'Contacto' END",
            "contact_id": "CASE WHEN event_id % 9 <> 0 THEN event_id END",
        },
    ),
    "exclusions": Logical(
        "customer",
        copies=2,
        where="c_custkey % 4 = 0 AND (n = 0 OR c_custkey % 8 = 0)",
        columns={
            "account": _campaign_account("c_custkey"),
            "source": "'SRC' || CAST(n AS STRING)",
            "category": "CASE (c_custkey + 4 * n) % 20 WHEN 0 THEN 'Excluir' WHEN 4 THEN 'Phoenix'"
            " WHEN 8 THEN 'Candidato' WHEN 12 THEN 'VIP' ELSE 'Cesada' END",
        },
    ),
    "tickets": Logical(
        "events",
        columns={
            "account": _campaign_account("user_id"),
            "interaction_id": "user_id * 1000 + event_id % 40",
            "purpose": "CASE event_type WHEN 'error' THEN 'TICKET' WHEN 'click' THEN 'TRUCKROLL' ELSE 'INQUIRY' END",
            "status": "CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END",
            "start_ts": "ts",
        },
    ),
}


def logical_table(read: Callable[[str], DataFrame], name: str) -> DataFrame:
    """Build one logical table from its physical source(s)."""
    spec = LOGICAL[name]
    df = read(spec.source)
    if spec.join:
        other, left_key, right_key = spec.join
        right = read(other)
        df = df.join(right, df[left_key] == right[right_key])
    if spec.copies:
        df = df.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(spec.copies)])))
    if spec.where:
        df = df.where(spec.where)
    dialect = lambda e: re.sub(r"epoch_ms\((\w+)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", e)
    return df.select(*[F.expr(dialect(e)).alias(c) for c, e in spec.columns.items()])


def logical_sql(name: str) -> str:
    """The same table as a SELECT for the checking engine."""
    spec = LOGICAL[name]
    source = spec.source
    if spec.join:
        other, left_key, right_key = spec.join
        source += f" JOIN {other} ON {left_key} = {right_key}"
    if spec.copies:
        source += f", (SELECT unnest(generate_series(0, {spec.copies - 1}))::INT AS n) AS copies"
    exact = lambda e: e.replace("epoch_ms(ts)", "(epoch_us(ts) // 1000)")
    cols = ", ".join(f"{exact(e)} AS {c}" for c, e in spec.columns.items())
    where = f" WHERE {spec.where}" if spec.where else ""
    return f"SELECT {cols} FROM {source}{where}"
