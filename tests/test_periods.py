import datetime as dt
from decimal import Decimal

from featloom.operators import periods as per

D = dt.date
T = dt.datetime


def users(spark, uids=(1, 2)):
    return spark.createDataFrame([(u, 30, 1, D(2016, 1, 1), 5.0) for u in uids],
                                 "uid long, age int, sex int, active_date date, limit double")


def test_order_amount_clamp_and_missing_price(spark):
    orders = spark.createDataFrame([
        (1, D(2016, 8, 3), 1.0, 2, 7, 5.0),     # 1*2-5 < 0 -> 0
        (1, D(2016, 8, 4), -1.0, 2, 7, 0.0),    # missing price (-1) -> 0
        (1, D(2016, 8, 5), 3.0, 2, 9, 1.0),     # 5
    ], "uid long, buy_date date, price double, number int, cate_id long, discount double")
    f = per.order_features(orders).collect()[0]
    assert f.orderNum8 == 3 and f.orderAmount8 == 5.0 and f.discountAmount8 == 6.0
    assert f.avgDiscount8 == 2.0
    assert f.amountByCateId8 == "7:0.0;9:5.0"


def test_loan_plan_zero(spark):
    loans = spark.createDataFrame([(1, T(2016, 9, 1, 10), 10.0, 0), (1, T(2016, 9, 2, 10), 20.0, 2)],
                                  "uid long, loan_time timestamp_ntz, loan_amount double, plan_num int")
    f = per.loan_features(loans).collect()[0]
    assert f.loanNum9 == 2 and f.loanAmount9 == 30.0 and f.avgLoanPerPlan9 == 5.0
    assert f.loanNum8 == 0 and f.avgLoanPerPlan8 == 0.0


def test_clicks_maps_and_counts(spark):
    rows = [(1, T(2016, 8, 1, 1), 7, 4)] + [(1, T(2016, 8, 2, 1), 1, 45)] * 3 + [(1, T(2016, 8, 2, 2), 1, 30)] \
        + [(1, T(2016, 9, 2, 2), 10, 28)] * 2
    clicks = spark.createDataFrame(rows, "uid long, click_time timestamp_ntz, pid long, param long")
    f = per.click_features(clicks).collect()[0]
    assert f.clickNum8 == 5 and f.clickNum9 == 2 and f.clickNum10 == 0
    assert f.clickPage8 == "1:4;7:1"
    assert f.clickPageParam8 == "1_30:1;1_45:3;7_4:1"
    assert f.clickParam8 == "30:1;4:1;45:3"
    assert f.clickPage10 == ""


def test_null_pages_and_params_stay_in_the_maps(spark):
    rows = [(1, T(2016, 8, 1, 1), None, 5), (1, T(2016, 8, 1, 2), 3, None), (1, T(2016, 8, 1, 3), 3, 5)]
    clicks = spark.createDataFrame(rows, "uid long, click_time timestamp_ntz, pid long, param long")
    f = per.click_features(clicks).collect()[0]
    assert f.clickNum8 == 3
    assert (f.clickPage8, f.clickPageParam8, f.clickParam8) == (":1;3:2", "3_:1;3_5:1;_5:1", ":1;5:2")


def test_wide_defaults_and_layout(spark):
    clicks = spark.createDataFrame([(1, T(2016, 8, 1, 1), 7, 4)], "uid long, click_time timestamp_ntz, pid long, param long")
    orders = spark.createDataFrame([(1, D(2016, 10, 3), 2.0, 3, 5, 1.0)],
                                   "uid long, buy_date date, price double, number int, cate_id long, discount double")
    loans = spark.createDataFrame([(1, T(2016, 11, 1, 0), 9.0, 3)],
                                  "uid long, loan_time timestamp_ntz, loan_amount double, plan_num int")
    sums = spark.createDataFrame([(1, 4.0)], "uid long, loan_sum double")
    w = per.wide_features(users(spark), clicks, orders, loans, sums)
    from featloom.schemas import wide_columns
    assert w.columns == wide_columns()
    rows = {r.uid: r for r in w.collect()}
    assert rows[1].clickNum8 == 1 and rows[1].orderAmount10 == 5.0 and rows[1].loanAmount11 == 9.0
    assert rows[1].avgLoanPerPlan11 == 3.0 and rows[1].loanSum == 4.0
    u2 = rows[2]
    assert (u2.clickNum8, u2.clickPage9, u2.orderAmount10, u2.avgDiscount8, u2.loanSum) == (0, "", 0.0, 0.0, 0.0)


def test_period_sum_equals_total(spark):
    rows = [(1, T(2016, m, d, 1), 1, 1) for m in (7, 8, 9, 10, 11, 12) for d in (1, 2)]
    clicks = spark.createDataFrame(rows, "uid long, click_time timestamp_ntz, pid long, param long")
    f = per.click_features(clicks).collect()[0]
    assert f.clickNum8 + f.clickNum9 + f.clickNum10 + f.clickNum11 == 8


def test_decimal_sums_exact(spark):
    orders = spark.createDataFrame([(1, D(2016, 8, 1), Decimal("0.10"), 3, 1, Decimal("0.0000"))] * 10,
                                   "uid long, buy_date date, price decimal(18,2), number int, cate_id long, discount decimal(18,4)")
    f = per.order_features(orders).collect()[0]
    assert f.orderAmount8 == Decimal("3.0000")


def test_year_aware_periods_push_range(spark, scratch):
    from featloom.sources.parquet import load_table
    loans = spark.createDataFrame([(1, T(2016, 8, 1, 0), 10.0, 1), (1, T(2015, 8, 1, 0), 99.0, 1),
                                   (1, T(2016, 12, 31, 23), 5.0, 1), (1, T(2017, 1, 1, 0), 7.0, 1)],
                                  "uid long, loan_time timestamp_ntz, loan_amount double, plan_num int")
    loans.write.parquet(f"{scratch}/loans")
    df = load_table(spark, f"{scratch}/loans")
    f = per.loan_features(df, [201608, 201612], period="year_month")
    r = f.first()
    assert (r.loanAmount201608, r.loanAmount201612) == (10.0, 5.0)  # 2015-08 and 2017-01 excluded
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(loan_time" in plan and "LessThan(loan_time" in plan


def test_period_arrays_inverse_of_flatten(spark):
    orders = spark.createDataFrame([(1, D(2016, 9, 3), 2.0, 1, 5, 0.0)],
                                   "uid long, buy_date date, price double, number int, cate_id long, discount double")
    of = per.order_features(orders)
    arr = per.period_arrays(of, ["orderNum", "orderAmount"], keep=("uid",)).first()
    assert list(arr.orderNum) == [0, 1, 0, 0] and list(arr.orderAmount) == [0.0, 2.0, 0.0, 0.0]
