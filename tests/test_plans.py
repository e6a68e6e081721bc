"""Plan-shape regression tests: the scale properties the README claims."""

import os
import re

import pytest

from featloom.operators import latest as lat
from featloom.operators import periods as per
from featloom.plans import catalog
from featloom.plans import tables as t

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_click_features_two_shuffles_no_expand(no_broadcast):
    plan = plan_of(per.click_features(t.clicks(no_broadcast, SF), (1, 2, 3, 4), period="week"))
    assert shuffles(plan) == 2 and "Expand" not in plan
    assert plan.count("FileScan") == 1
    assert "partial_count" in plan  # raw rows are combined map-side before the shuffle


def test_wide_joins_reuse_uid_partitioning(no_broadcast):
    plan = plan_of(catalog._wide(no_broadcast, SF))
    # clicks 2, orders 2 + 4 for the adapter's two shuffle joins, loans 1, loan sums 1, users 1;
    # the feature frames reach the user joins already partitioned by uid
    assert shuffles(plan) == 11
    assert plan.count("SortMergeJoin") == 6


def test_trailing_columns_add_no_shuffle(no_broadcast):
    w = catalog._wide(no_broadcast, SF)
    base = shuffles(plan_of(w))
    assert shuffles(plan_of(lat.latest_map(lat.latest_numeric(w)))) == base


def test_cutoff_reaches_the_scan(spark):
    plan = plan_of(catalog.cutoff_filtered_users(spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate,1998-11-01T00:00\)", plan)


def test_labelled_users_one_customer_scan(no_broadcast):
    plan = plan_of(catalog.rmse_zero_baseline(no_broadcast, SF))
    assert len(re.findall(r"FileScan parquet \[c_", plan)) == 1


def test_single_feature_fit_stores_nothing(spark):
    assert "InMemoryTableScan" not in plan_of(catalog.linreg_single_feature(spark, SF))


def test_clicks_reach_months_and_both_sides_of_the_cutoff(spark):
    c = t.clicks(spark, SF)
    n = c.count()
    for rows in (c.where("month(click_time) < 9"), c.where(f"click_time < timestamp_ntz'{catalog.CUTOFF}'")):
        assert 0 < rows.count() < n
    assert {r.m for r in c.selectExpr("month(click_time) AS m").distinct().collect()} >= {8, 9, 10, 11}


def test_snapshot_one_shuffle_per_behaviour_table(no_broadcast):
    plan = plan_of(catalog.user_snapshot_union(no_broadcast, SF))
    # clicks 1, loans 1, users 1, orders: 1 aggregate + 4 for the adapter's two shuffle joins
    assert shuffles(plan) == 8
