"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campanula.operators.snapshot import latest_snapshot, snapshot_at
from campanula.sources.tables import links_for_day, scan
from campanula.functions.dates import to_date_lit

HEAVY = [
    "or_equi_join", "theta_case_join", "interval_join_days", "interval_nearest_days", "cross_join_filtered", "customer_features",
    "bau_offer", "last_order_first_bill", "old_new_price", "audience_sizes", "email_link_generation_target",
    "multi_offer_call_activation", "converted_within_days", "campaign_base",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_nested_loop_cross_join_or_python(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    for word in ("NestedLoop", "Cartesian", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = plan_of(scan(events, since=("ts", "2024-01-20"), partition={"event_type": "click"}, columns=["event_id"]))
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,click)" in plan
    assert "props" not in plan


def test_partitioned_snapshots_are_pruned(spark, tmp_path):
    path = str(tmp_path / "snap")
    spark.range(20).select("id", (F.lit("2024-01-01").cast("date") + (F.col("id") % 4).cast("int")).alias("as_of")).write.partitionBy(
        "as_of"
    ).parquet(path)
    df = spark.read.parquet(path)
    newest = latest_snapshot(df, "as_of")
    assert newest.count() == 5
    assert "PartitionFilters: [isnotnull(as_of" in plan_of(newest)
    fixed = plan_of(snapshot_at(df, "as_of", to_date_lit("2024-01-02")))
    assert "PartitionFilters: [isnotnull(as_of" in fixed


def test_link_day_is_a_range_on_the_raw_column(spark, tmp_path):
    path = str(tmp_path / "offers")
    spark.createDataFrame([(1, 1706140800000, "x"), (2, 1706227200000, None)], "id int, link_ms long, link string").write.parquet(path)
    kept = links_for_day(spark.read.parquet(path), "2024-01-25")
    assert [r.id for r in kept.collect()] == [1]
    assert "GreaterThanOrEqual(link_ms,1706140800000)" in plan_of(kept)


def test_account_inputs_are_shuffled_once(spark, sf_dir):
    """Joined without broadcast, the wide base shuffles each input by account
    once and the joins reuse that partitioning."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(entry.queries()["audience_call_retargeting"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("Exchange hashpartitioning(account_no") == 3
