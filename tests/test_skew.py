"""Operators on data where one key holds most rows, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from campanula.operators import joining, ranking, snapshot

D = dt.date


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = [None] * 400 + [1] * 500 + [rng.randrange(2, 60) for _ in range(300)]
    return [(i, k, rng.choice([None, "a", "b", "c"]), rng.randrange(5)) for i, k in enumerate(keys)]


def test_lookup_with_hot_and_null_keys(spark, rows):
    df = spark.createDataFrame(rows, "id long, k int, g string, v int")
    dim = df.groupBy("k").agg(F.sum("v").alias("total")).where("k IS NULL OR k % 2 = 1")
    want = {}
    for _, k, _, v in rows:
        want[k] = want.get(k, 0) + v
    for options in ({"hot_rows": 100, "small_bytes": 0}, {"hot_rows": 1, "small_bytes": 0}, {}):
        got = joining.lookup(df, dim, "k", **options).collect()
        assert len(got) == len(rows)
        assert all(r.total == (want[r.k] if r.k is None or r.k % 2 == 1 else None) for r in got)


@pytest.mark.parametrize("piece_rows", [1, 7, 100, 10_000])
def test_rank_large_equals_row_number(spark, rows, piece_rows):
    df = spark.createDataFrame(rows, "id long, k int, g string, v int").withColumn("part", F.lit("x"))
    got = ranking.rank_large(df, ["part"], [("g", False), ("v", True)], "id", "place", piece_rows=piece_rows, small_bytes=0)
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", -r[3], r[0]))
    want = {r[0]: i + 1 for i, r in enumerate(order)}
    assert {r.id: r.place for r in got.collect()} == want


def test_top_capacity_equals_global_top(spark, rows):
    df = spark.createDataFrame(rows, "id long, k int, g string, v int").withColumn("part", F.lit("x"))
    got = ranking.top_capacity(df, ["part"], [("v", True), ("id", False)], 100, 0.1, piece_rows=50).collect()
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:10]]
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == want


def test_intervals_of_one_busy_key(spark):
    rng = random.Random(3)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))
    left = [(i, 1 if i % 3 else rng.randrange(5), day()) for i in range(300)]
    right = [(i, 1 if i % 3 else rng.randrange(5), day()) for i in range(200)]
    lf = spark.createDataFrame(left, "lid int, k int, a date")
    rf = spark.createDataFrame(right, "rid int, k int, b date")
    for low, high in ((0, 1), (-3, 4), (5, 20), (0, 0)):
        pairs = {(l[0], r[0]) for l in left for r in right if l[1] == r[1] and low <= (r[2] - l[2]).days <= high}
        got = [(r.lid, r.rid) for r in joining.interval_join(lf, rf, "k", "a", "b", low, high).collect()]
        assert len(got) == len(pairs) and set(got) == pairs
        nearest = {}
        for l in left:
            hits = [r[2] for r in right if l[1] == r[1] and low <= (r[2] - l[2]).days <= high]
            if hits:
                nearest[(l[1], l[2])] = max(hits)
        found = joining.nearest_in_window(lf, rf, "k", "a", "b", low, high, "n").collect()
        assert {(r.k, r.a): r.n for r in found} == nearest and len(found) == len(nearest)


def test_top_row_is_pruned_before_the_shuffle(spark, rows):
    df = spark.createDataFrame(rows, "id long, k int, g string, v int")
    plan = snapshot.latest_row(df, ["k"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
