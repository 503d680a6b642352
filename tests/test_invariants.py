"""Checks that hold for any data: totals, disjointness, uniqueness, capacity."""

import pytest
from pyspark.sql import functions as F

from campanula.plans import audiences as au
from campanula.plans import collections as co
from campanula.plans import retention as rt
from campanula.registry import audiences as ra
from campanula.registry import collections as rc
from campanula.registry.base import AS_OF, Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_class_totals_equal_the_base(t):
    totals = {r.dt: r.accounts for r in rt.tenure_class_totals(t.monthly_snapshot).collect()}
    plain = {
        r.dt: r.n
        for r in t.monthly_snapshot.where(F.dayofmonth("dt") == 1).groupBy("dt").agg(F.count_distinct("account_no").alias("n")).collect()
    }
    assert totals == plain


def test_suppressed_accounts_are_absent(t):
    inputs = ra.inputs(t)
    base = au.wide_base(inputs, AS_OF)
    chosen = au.email_link_generation_target(base, AS_OF)
    suppressed = au.named_audience(inputs, AS_OF, "email_retargeting").union(
        au.named_audience(inputs, AS_OF, "sidegrade_retargeting")
    )
    assert chosen.join(suppressed, "account_no", "left_semi").count() == 0


def test_set_algebra_equals_the_single_filter(t):
    inputs = ra.inputs(t)
    base = au.wide_base(inputs, AS_OF)
    sets = au.activate(
        base,
        [
            au.audience(base, au.cross_eligible_rule(AS_OF)),
            au.audience(base, au.email_eligible_rule(AS_OF)),
            au.audience(base, au.single_offer_rule(today_only=True)),
            au.audience(base, F.col("is_target")),
        ],
        [au.audience(base, au.contacted_recently_rule()), au.audience(base, au.sidegrade_retargeting_rule(AS_OF))],
    )
    single = au.email_link_generation_target(base, AS_OF)
    assert {r[0] for r in sets.collect()} == {r[0] for r in single.collect()}


def test_wide_base_has_one_row_per_account(t):
    base = au.wide_base(ra.inputs(t), AS_OF)
    assert base.count() == base.select("account_no").distinct().count() == t.customer.count()


def test_campaign_respects_capacity_and_ranks_are_dense(t):
    out = co.campaign(rc.sources(t), AS_OF, agent_capacity=20, candidate_capacity=2).collect()
    assert len({r.account for r in out}) == len(out)
    agent = [r for r in out if r.contact_channel == "AGENT CALL" and r.customer_group == "Treatment_group"]
    assert 0 < len([r for r in agent if r.check_phone == "valid_phone"]) <= 18
    assert len([r for r in out if r.contact_channel == "AGENT CALL Candidate"]) <= 2
    groups = {}
    for r in out:
        if r.rank is not None:
            groups.setdefault((r.customer_group, r.check_phone), []).append(r.rank)
    assert groups and all(sorted(g) == list(range(1, len(g) + 1)) for g in groups.values())
