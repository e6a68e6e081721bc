import datetime as dt

from featloom.operators import snapshot as snp

D = dt.date
T = dt.datetime


def frames(spark):
    users = spark.createDataFrame([(1, 30, 1, D(2016, 1, 1), 5.0), (2, 40, 2, D(2016, 2, 1), 6.0)],
                                  "uid long, age int, sex int, active_date date, limit double")
    clicks = spark.createDataFrame([(1, T(2016, 8, 1, 0), 1, 1), (1, T(2016, 9, 1, 0), 1, 1),
                                    (1, T(2016, 10, 1, 0), 1, 1), (1, T(2015, 12, 1, 0), 1, 1)],
                                   "uid long, click_time timestamp_ntz, pid long, param long")
    orders = spark.createDataFrame([(1, D(2016, 8, 3), 2.0, 1, 5, 0.0)],
                                   "uid long, buy_date date, price double, number int, cate_id long, discount double")
    loans = spark.createDataFrame([(1, T(2016, 8, 1, 0), 10.0, 1), (1, T(2016, 9, 5, 0), 7.0, 1),
                                   (1, T(2016, 9, 6, 0), 3.0, 1)],
                                  "uid long, loan_time timestamp_ntz, loan_amount double, plan_num int")
    return users, clicks, orders, loans


def test_month_boundary_and_label(spark):
    users, clicks, orders, loans = frames(spark)
    rows = {(r.uid, r.snapshot_month): r for r in snp.snapshot(users, clicks, orders, loans, [9], run_id=7).collect()}
    r = rows[(1, 9)]
    # month 8 kept; month 9, 10 and the December (year ignored, month 12 >= 9) click dropped
    assert r.n_clicks == 1 and r.n_orders == 1 and r.n_loans == 1 and r.loan_amount == 10.0
    assert r.loan_sum == 10.0  # month-9 loans are the label
    assert r.id == "1_9_7"
    e = rows[(2, 9)]
    assert (e.n_clicks, e.n_orders, e.n_loans, e.loan_sum) == (0, 0, 0, 0)


def test_union_of_months(spark):
    users, clicks, orders, loans = frames(spark)
    s = snp.snapshot(users, clicks, orders, loans, [9, 10, 11])
    assert s.count() == 6
    got = {r.snapshot_month: r.n_clicks for r in s.where("uid = 1").collect()}
    assert got == {9: 1, 10: 2, 11: 3}


def test_cutoff(spark):
    clicks = spark.createDataFrame([(1, T(2016, 10, 31, 23, 59, 59), 1, 1), (1, T(2016, 11, 1, 0, 0, 0), 1, 1)],
                                   "uid long, click_time timestamp_ntz, pid long, param long")
    kept = snp.before(clicks, "click_time", "2016-11-01 00:00:00").collect()
    assert len(kept) == 1 and kept[0].click_time.day == 31
    dates = spark.createDataFrame([(D(2016, 10, 31),), (D(2016, 11, 1),)], "d date")
    assert snp.before(dates, "d", "2016-11-01 00:00:00").count() == 1
    assert snp.before(dates, "d", "2016-11-01 08:00:00").count() == 2


def test_duplicate_loan_sum_duplicates_user(spark):
    users, clicks, orders, loans = frames(spark)
    ls = spark.createDataFrame([(1, 1.0), (1, 2.0)], "uid long, loan_sum double")
    out = snp.assemble_counts(users, clicks, orders, loans, ls)
    assert out.where("uid = 1").count() == 2
    assert out.where("uid = 2").first().loan_sum == 0


def test_loan_label(spark):
    users, clicks, orders, loans = frames(spark)
    got = {r.uid: r.loan_sum for r in snp.loan_label(users, loans, 9).collect()}
    assert got == {1: 10.0, 2: 0}


def test_snapshot_records_flat_form(spark, scratch):
    from featloom import sinks
    from featloom.sources.parquet import load_table
    users, clicks, orders, loans = frames(spark)
    recs = snp.snapshot_records(clicks, "click_time", [9, 10, 11], run_id=3)
    got = sorted((r.snapshot_month, r.click_time.month) for r in recs.collect())
    # month 8 precedes 9, 10, 11; month 9 precedes 10, 11; month 10 precedes 11; December precedes none
    assert got == [(9, 8), (10, 8), (10, 9), (11, 8), (11, 9), (11, 10)]
    assert {r.id for r in recs.where("snapshot_month = 9").collect()} == {"1_9_3"}
    sinks.write_parquet(recs, f"{scratch}/snap", partition_by="snapshot_month")
    back = load_table(spark, f"{scratch}/snap")
    assert back.where("snapshot_month = 11").count() == 3
    assert {d for d in os.listdir(f"{scratch}/snap") if d.startswith("snapshot_month=")} == \
        {"snapshot_month=9", "snapshot_month=10", "snapshot_month=11"}


import os  # noqa: E402
