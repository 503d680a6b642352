"""Operators that must hold at any size: split keys, prefix sums, thresholds, merges and periods."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campanula.operators import grouping, joining, ranking
from campanula.plans import attribution, dashboards, offers, pricing
from campanula.registry import dashboards as registered
from campanula.registry.base import Tables
from campanula.sources import tables

D = dt.date


@pytest.fixture
def plain(spark):
    """Joins by shuffle and as planned, so that tests see where rows go."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def codes(spark, n=6000):
    """A third of all rows without code, a third with one code."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 1, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("c"), F.col("id") % 1700)).alias("code")
    )


def test_no_task_takes_all_rows_of_a_code_or_of_none(plain):
    df = codes(plain)
    dim = df.select("code").distinct().where("code IS NOT NULL").select(F.col("code").alias("key"), F.length("code").alias("price"))
    joined = joining.role_join(df, dim, "key", {"old": "code"}, hot_rows=100, small_bytes=0)
    assert most_in_a_task(joined) < 6000 / 5
    rows = joined.collect()
    assert len(rows) == 6000 and all(r.old_price == (None if r.code is None else len(r.code)) for r in rows)
    light = joining.role_join(df, dim, "key", {"old": "code"})  # plain, as the table is small
    # the condition keeps the join, which a count of rows alone would drop as the codes are unique
    assert most_in_a_task(light.where("old_price IS NULL OR old_price > 0")) >= 2000
    assert sorted(map(str, light.collect())) == sorted(map(str, rows))


def test_the_dimension_waits_for_no_weights(plain):
    df = codes(plain).select("id", "code", F.when(F.col("id") % 2 == 0, F.col("code")).alias("other"))
    dim = df.select("code").distinct().where("code > 'c5' AND code <> 'c7'").select(F.col("code").alias("key"), F.length("code").alias("price"))
    for keys in (dim, dim.where("key <> 'hot'")):  # also without a row for the heaviest code
        joined = joining.role_join(df, keys, "key", {"old": "code", "new": "other"}, hot_rows=100, small_bytes=0)
        assert "sequence(" not in joined._jdf.queryExecution().optimizedPlan().toString()  # no copies per place
        assert most_in_a_task(joined) < 6000 / 5
        known = {r.key: r.price for r in keys.collect()}
        rows = joined.collect()
        assert len(rows) == 6000 and all(r.old_price == known.get(r.code) and r.new_price == known.get(r.other) for r in rows)
    null = plain.createDataFrame([(None, 1), ("hot", 2), ("c2", 3)], "code string, v int")
    found = joining.lookup(codes(plain), null, "code", hot_rows=100, small_bytes=0)
    assert {(r.code, r.v) for r in found.where("v IS NOT NULL").collect()} == {(None, 1), ("hot", 2), ("c2", 3)} and found.count() == 6000


def test_prices_of_few_codes_are_split(plain):
    df = codes(plain).select("id", F.col("code").alias("a"), F.col("code").alias("b"), F.lit(1).alias("old_dvr"), F.lit(0).alias("new_dvr"))
    prices = plain.createDataFrame([("hot", 10.0), ("c2", 20.0)], "package_code string, price double")
    book = plain.createDataFrame([("hot",), ("hot",)], "package_code string")
    out = pricing.old_new_price(df, prices, book, old_code="a", new_code="b", hot_rows=100, small_bytes=0)
    assert most_in_a_task(out) < 6000 / 5
    assert {(r.a, r.old_price, r.new_price) for r in out.where("a IS NULL OR a = 'hot'").collect()} == {(None, None, None), ("hot", 15.0, 10.0)}


def test_many_hot_keys_and_a_residual(plain):
    left = plain.range(9000).select("id", (F.col("id") % 1500).alias("k"))
    right = plain.range(1500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    found = joining.lookup(left, right.select(F.col("key").alias("k"), "v"), "k", hot_rows=2, small_bytes=0)
    assert found.where("v = 2 * k").count() == 9000
    some = joining.theta_join(left, right, {"k": "key"}, {"v": "v"}, F.col("v") > F.col("id"), hot_rows=2, small_bytes=0)
    want = sum(1 for i in range(9000) if 2 * (i % 1500) > i)
    assert some.count() == 9000 and some.where("v IS NOT NULL").count() == want


def test_the_list_of_heavy_keys_is_bounded(plain):
    weights = plain.range(50_000).select(F.col("id").alias("_key0"), F.lit(1).alias("_rows"))
    unit = weights.select(F.sum("_rows")).first()[0] / joining.SHARE
    assert weights.where(F.col("_rows") > unit).count() == 0 and joining.SHARE * unit == 50_000


@pytest.mark.parametrize("seed", range(3))
def test_rank_large_over_clustered_ids(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample([*range(500), *range(10**12, 10**12 + 500), *range(-300, 0)], 900)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice("ab")) for i in ids]
    df = spark.createDataFrame(rows, "id long, v int, p string")
    for piece_rows in (1, 3, 400):
        got = ranking.rank_large(df, ["p"], [("v", True)], "id", "place", piece_rows=piece_rows, small_bytes=0).collect()
        for p in "ab":
            order = sorted((r for r in rows if r[2] == p), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
            assert {r.id: r.place for r in got if r.p == p} == {r[0]: i + 1 for i, r in enumerate(order)}


def test_no_job_runs_while_plans_are_built(spark, sf_dir):
    sc = spark.sparkContext
    sc.setJobGroup("building", "building")
    for name in ("inbound_performance", "email_performance", "collections_campaign", "rank_within_group", "topk_capacity", "bau_offer"):
        t = Tables(spark, sf_dir)
        for table in tables.TABLES:
            t.read(table)  # schemas are read once; nothing below may start a job
        before = set(sc.statusTracker().getJobIdsForGroup("building"))
        from campanula.registry import load

        load()[name].build(t)
        assert set(sc.statusTracker().getJobIdsForGroup("building")) == before, name
    sc.setJobGroup("other", "other")


def test_capacity_reads_no_whole_group(plain):
    df = plain.range(60_000).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 60_013).cast("double")).alias("v"))
    out = ranking.top_capacity(df, ["g"], [("v", True), ("id", False)], 4000, piece_rows=500)
    got = sorted((r.g, r.position, r.id) for r in out.collect())
    rows = sorted(((i % 2, -(i * 7919 % 60_013), i) for i in range(60_000) if i % 11), key=lambda r: r)
    want = []
    for g in (0, 1):
        want += [(g, k + 1, r[2]) for k, r in enumerate([r for r in rows if r[0] == g][:4000])]
    assert got == want
    plan = out._jdf.queryExecution().executedPlan()
    joined = [n.metrics().apply("numOutputRows").value() for n in nodes(plan) if n.nodeName() in ("SortMergeJoin", "BroadcastHashJoin")]
    assert joined and max(joined) < 2 * (4000 + 2 * 500)


def test_capacity_with_nulls_and_few_valued_columns(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Tier_1", "Tier_2", None]), rng.choice([None, 1, 2, 3])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, tier string, decile int").withColumn("g", F.lit(1))
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or 0, r[0]))
    for places in (1, 50, 699, 5000):
        got = ranking.top_capacity(df, ["g"], [("tier", False), ("decile", False), ("id", False)], places, exact=2, piece_rows=9).collect()
        assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r[0] for r in order[:places]]


def test_as_of_looks_back_any_time(spark):
    left = spark.createDataFrame([(1, D(2024, 1, 31)), (2, D(2024, 1, 31))], "k long, a date")
    right = spark.createDataFrame([(1, D(1800, 1, 1)), (1, D(1799, 1, 1)), (2, D(2024, 2, 1))], "k long, b date")
    got = joining.asof_backward(left, right, "k", "a", "b", "n").collect()
    assert [(r.k, r.n) for r in got] == [(1, D(1800, 1, 1))]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("width", [None, 1.0, 7.5, 1e6])
def test_successor(spark, strict, width):
    rng = random.Random(width or 0)
    asked = [(rng.choice("ab"), rng.randint(-20, 60) / 2) for _ in range(120)] + [("c", 1.0)]
    kept = [(rng.choice("ab"), rng.randint(-20, 50) / 2, rng.randint(0, 9)) for _ in range(40)]
    q = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "i int, g string, at double")
    e = spark.createDataFrame(kept, "g string, at double, v int")
    want = {}
    for i, (g, at) in enumerate(asked):
        there = sorted((x, v) for h, x, v in kept if h == g and (x > at or (x == at and not strict)))
        if there:
            want[i] = there[0][1]
    got = joining.successor(q, e, ["g"], "at", "v", strict=strict, width=width).collect()
    assert {r.i: r.v for r in got} == want and len(got) == len(want)


def test_catalogue_offers_over_many_prices_and_speeds(spark):
    rng = random.Random(9)
    book = [(f"P{i}", "FTTH", "2P", "UPICK", rng.randrange(2000, 12_000) / 100, rng.choice([10, 50, 100, 300, 500, 1000, i]), "m", "p") for i in range(10_000)]
    people = [(i, "FIBER", "2P HSD Voice" if i % 50 == 0 else "3P Video HSD Voice", "UPICK", "x", f"O{i}", rng.choice([19.99, 65.5, 119.0, rng.randrange(1500, 12_500) / 100]), rng.choice([None, 0, 10, 77, 1000, 9000]), "dvr" if i % 4 == 0 else None) for i in range(1500)]
    front = spark.createDataFrame(book, "package_code string, connection string, play string, tv string, price double, speed int, modem string, phone string")
    profile = spark.createDataFrame(people, "account_no long, drop_type string, play_type string, video_service string, a string, package_code string, total_charge double, down_speed int, stb_sc string")
    three = front.withColumn("play", F.lit("3P"))
    got = {r.account_no: (r.price_to, r.speed_to, r.package_to) for r in offers.bau_offer(profile, three, hot_rows=20, small_bytes=0).collect()}
    by_speed = {s: sorted((b[4], -b[5], b[0]) for b in book if b[5] >= s) for s in (0, 10, 77, 1000, 9000)}
    want = {}
    for i, _, play, _, _, _, charge, speed, stb in people:
        if speed is None or not play.startswith("3P"):
            continue
        extra = 5 if stb else 0
        options = by_speed[speed]
        at = bisect.bisect_right(options, charge, key=lambda o: o[0] + extra)
        if at < len(options):
            price, slow, code = options[at]
            want[i] = (price, -slow, code)
    assert got == want
    plan = offers.bau_offer(profile, three)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan


def test_periods_are_a_key(spark, sf_dir):
    days = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 15)), (3, D(2024, 3, 1)), (4, None)], "id int, day date")
    periods = [("2024-01-01", "2024-01-15"), ("2024-01-10", "2024-01-31"), ("2024-02-01", "2024-02-02")]
    got = {(r.id, r.period) for r in attribution.in_periods(days, "day", periods).collect()}
    assert got == {(1, 0), (2, 0), (2, 1)}
    t = Tables(spark, sf_dir)

    def scans(periods):
        built = dashboards.inbound_periods(*registered.inbound_tables(t), periods=periods)
        return built._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    week = [(f"2024-01-{d:02d}", f"2024-01-{d + 1:02d}") for d in range(1, 30, 2)]
    assert scans(week) == scans(week[:1])


def test_rounding_half_up(spark):
    rows = [(n, d) for d in range(0, 60) for n in range(0, d + 1)]
    df = spark.createDataFrame(rows, "n long, d long").select("n", "d", grouping.half_up(F.col("n"), F.col("d")).alias("r"))
    for r in df.collect():
        assert r.r == (None if r.d == 0 else (200 * r.n + r.d) // (2 * r.d) / 100)


def test_multisets(spark):
    rows = [(1, "B"), (1, "a"), (1, "B"), (1, None), (2, None), (3, "x")] + [(4, "hot")] * 3
    df = spark.createDataFrame(rows, "k int, c string")
    assert {tuple(r) for r in grouping.multiset(df, ["k"], F.col("c"), "c").collect()} == {(1, "B", 2), (1, "a", 1), (3, "x", 1), (4, "hot", 3)}
    got = {(r.k, r.t, r.entries) for r in grouping.fold_strings(df, ["k"], "c", "t").collect()}
    assert got == {(1, "b,b,a", 3), (2, "", 0), (3, "x", 1), (4, "hot,hot,hot", 3)}


def test_single_file_export_is_ordered(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 3001 % 5003).alias("k"), F.lit('a,"b"').alias("t")).repartition(7)
    path = str(tmp_path / "one")
    tables.export_csv(df, path, single_file=True, order=[F.col("k").asc()])
    parts = list((tmp_path / "one").glob("part-*.csv"))
    lines = parts[0].read_text().splitlines()
    assert len(parts) == 1 and lines[0] == "k,t" and [int(x.split(",")[0]) for x in lines[1:]] == sorted(i * 3001 % 5003 for i in range(5000))
    tables.export_csv(df.limit(0), str(tmp_path / "none"), single_file=True)
    assert [p.read_text() for p in (tmp_path / "none").glob("part-*.csv")] == ["k,t\n"]


def test_latest_city_breaks_ties_by_value(spark):
    rows = [(1, D(2024, 1, 1), "b", "x", 0.2), (1, D(2024, 1, 2), "a", "x", 3.0), (1, D(2024, 1, 2), "b", None, 0.7), (2, None, "c", "y", None)]
    df = spark.createDataFrame(rows, "account_no long, as_of date, city string, addr1 string, tenure double")
    got = {(r.account_no, r.city, r.tenure_class) for r in attribution.latest_city_tenure(df).collect()}
    assert got == {(1, "b", "6_12_months"), (2, "c", None)}


def test_flagship_is_registered(spark):
    assert entry.FLAGSHIP in entry.queries()
