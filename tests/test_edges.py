"""Hand-made rows: NULLs, blanks, ties, month ends, bad ids, window limits."""

import datetime as dt
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from campanula.functions import dates, keys, rules, text
from campanula.operators import joining, ranking, snapshot
from campanula.plans import attribution, collections, customers, pricing

D = dt.date


def values(spark, rows, schema, **cols):
    out = spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()
    return [tuple(r) for r in out]


def test_bundle_resolution_over_all_combinations(spark):
    options = [None, " ", "R1AAA", "R2BBB", "R1AAA-extra"]
    rows = list(itertools.product(options, repeat=3))

    def expected(row):
        if any(c is None for c in row):
            return None
        named = {c[:5] for c in row if c != " "}
        return " " if not named else named.pop() if len(named) == 1 else None

    got = values(spark, rows, "a string, b string, c string", v=pricing.resolve_bundle(["a", "b", "c"]))
    assert [g[0] for g in got] == [expected(r) for r in rows]


def test_x_flags_read_null_and_other_text_as_false(spark):
    got = values(spark, [("X",), ("x",), ("",), (" ",), (None,)], "f string", v=rules.is_x("f"))
    assert [g[0] for g in got] == [True, False, False, False, False]


def test_complete_months_agrees_with_the_checking_engine(spark):
    days = [D(2023, 1, 31), D(2023, 2, 1), D(2023, 2, 28), D(2024, 2, 29), D(2024, 3, 30), D(2024, 3, 31), D(2024, 4, 30), D(2022, 12, 15)]
    pairs = [(a, b) for a in days for b in days if a <= b]
    got = values(spark, pairs, "a date, b date", v=dates.complete_months("a", "b"))
    con = duckdb.connect()
    want = [con.execute("SELECT date_sub('month', ?::DATE, ?::DATE)", [a, b]).fetchone()[0] for a, b in pairs]
    assert [g[0] for g in got] == want


def test_month_ends(spark):
    got = values(
        spark,
        [(D(2023, 2, 28),), (D(2024, 3, 31),), (D(2024, 1, 30),)],
        "d date",
        sticky=dates.add_months_sticky("d", -1),
        plain=F.add_months("d", -1),
    )
    assert got == [
        (D(2023, 1, 31), D(2023, 1, 28)),
        (D(2024, 2, 29), D(2024, 2, 29)),
        (D(2023, 12, 30), D(2023, 12, 30)),
    ]


@pytest.mark.parametrize(
    ("as_of", "cycle", "want"),
    [
        ("2024-01-10", 15, D(2023, 12, 15)),  # previous month is in the previous year
        ("2024-01-10", 10, D(2024, 1, 10)),
        ("2024-03-10", 31, D(2024, 2, 29)),  # the month is shorter than the cycle day
        ("2024-04-30", 31, D(2024, 3, 31)),
    ],
)
def test_cycle_bill_date(spark, as_of, cycle, want):
    assert values(spark, [(cycle,)], "c int", v=dates.cycle_bill_date(as_of, "c")) == [(want,)]


def test_epoch_days_before_and_after_zero(spark):
    rows = [(0,), (86_399_999,), (86_400_000,), (-1,), (None,)]
    got = values(spark, rows, "ms long", v=dates.epoch_ms_to_date("ms"))
    assert [g[0] for g in got] == [D(1970, 1, 1), D(1970, 1, 1), D(1970, 1, 2), D(1969, 12, 31), None]


def test_names_without_comma(spark):
    rows = [("LAST,FIRST",), ("ONLY",), (None,), ("A,B,C",)]
    got = values(spark, rows, "n string", f=text.first_name("n"), l=text.last_name("n"))
    assert got == [("FIRST", "LAST"), ("ONLY", ""), (None, None), ("B,C", "A")]


def test_first_valid_id(spark):
    rows = [
        ("12345678901", "123456789012", None),
        ("1234567890123", None, "abcdefghijkl"),
        ("000000000000", "999999999999", None),
    ]
    got = values(spark, rows, "a string, b string, c string", v=keys.first_valid_id(["a", "b", "c"]))
    assert [g[0] for g in got] == ["123456789012", None, "999999999999"]


def test_speed_and_clock_parsing(spark):
    got = values(spark, [("1 Giga",), ("300 Megas",), ("none",), (None,)], "s string", v=text.speed_mbps("s"))
    assert [g[0] for g in got] == [1000, 300, None, None]
    got = values(spark, [("05/01/2024 12:03:04 a.m.",), ("05/01/2024 01:00:00 p.m.",)], "s string", v=dates.parse_clock_text("s"))
    assert [g[0].hour for g in got] == [0, 13]


def test_like_none_keeps_null(spark):
    rows = [(None,), ("cliente success",), ("buzon",)]
    got = values(spark, rows, "o string", v=text.like_none("o", collections.SETTLED_OUTCOMES))
    assert [g[0] for g in got] == [True, False, True]


def test_latest_rows_and_ties(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), 1), (1, D(2024, 1, 2), 2), (1, D(2024, 1, 2), 3), (2, None, 4)], "k int, d date, id int")
    ties = {(r.k, r.id) for r in snapshot.latest_ties(df, ["k"], "d").collect()}
    assert ties == {(1, 2), (1, 3)}
    assert {(r.k, r.id) for r in snapshot.latest_tied_rows(df, ["k"], F.col("d").desc()).collect()} == ties | {(2, 4)}
    one = snapshot.latest_row(df, ["k"], [F.col("d").desc(), F.col("id").asc()]).collect()
    assert {(r.k, r.id) for r in one} == {(1, 2), (2, 4)}


def test_order_window_limits(spark):
    touches = spark.createDataFrame([(1, D(2024, 1, 10)), (2, D(2024, 1, 10)), (3, D(2024, 1, 10)), (4, D(2024, 1, 10))], "account_no long, touch_date date")
    orders = spark.createDataFrame(
        [
            (1, 1, D(2024, 1, 9), "UPGRADE"),  # before the send
            (2, 2, D(2024, 1, 10), "UPGRADE"),  # on the day
            (3, 3, D(2024, 2, 9), "UPGRADE"),  # day 30
            (4, 4, D(2024, 2, 10), "UPGRADE"),  # day 31
            (2, 5, D(2024, 1, 20), "RESTART"),  # not a plan change
        ],
        "account_no long, order_no long, order_date date, ord_typ string",
    ).withColumn("order_ts", F.col("order_date").cast("timestamp"))
    got = {r.order_no for r in attribution.attribute_orders(touches, orders).collect()}
    assert got == {2, 3}


def test_tri_state_flags(spark):
    rows = [(D(2024, 1, 1), "R1"), (D(2024, 1, 9), "R1"), (D(2024, 1, 9), None), (None, None), (None, "R1")]
    got = values(spark, rows, "o date, b string", v=attribution.before_or_known("o", F.lit(D(2024, 1, 5)), "b"))
    assert [g[0] for g in got] == [1, 0, None, None, 0]


def test_price_change_with_unknown_prices(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, None), (7.0, 5.0), (5.0, 5.0)], "new_price double, old_price double")
    got = [(r.price_dif, r.up_down, r.positive_price_dif, r.negative_price_dif) for r in pricing.price_delta(df).collect()]
    assert got == [(0.0, "EQUAL", 0, 0), (None, "EQUAL", 0, 0), (2.0, "UP", 1, 0), (0.0, "EQUAL", 0, 0)]


def test_product_count_is_a_bit_mask(spark):
    rows = [(f"R{c}XXX",) for c in "012345678"] + [("RJ2F5",), (None,)]
    got = values(spark, rows, "c string", v=attribution.product_count("c"))
    assert [g[0] for g in got] == [0, 1, 1, 2, 1, 2, 2, 3, 0, 0, 0]


def test_any_key_lookup_keeps_unmatched_rows_once(spark):
    df = spark.createDataFrame([(1, "a", "a", "b"), (2, "x", "y", None), (3, "b", " ", "b")], "id int, p string, q string, r string")
    dim = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "code string, price double")
    got = sorted((r.id, r.found) for r in joining.any_key_lookup(df, dim, ["p", "q", "r"], "code", "price", "found").fillna(-1.0).collect())
    assert got == [(1, 1.0), (1, 2.0), (2, -1.0), (3, 2.0)]


def test_null_phone_is_shared(spark):
    rows = [(1, None), (2, None), (3, "5"), (4, "6"), (5, "6")]
    df = spark.createDataFrame(rows, "account_no long, home_phone string")
    got = {r.account_no: r.num_accounts for r in customers.accounts_per_phone(df).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2}


def test_gaps(spark):
    rows = [(1, D(2024, 1, d)) for d in (1, 2, 2, 5)] + [(2, D(2024, 1, 1))]
    got = [(r.k, r.d, r.gap_days) for r in ranking.gaps(spark.createDataFrame(rows, "k int, d date"), ["k"], "d").collect()]
    assert got == [(1, D(2024, 1, 5), 3)]
