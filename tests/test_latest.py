import pytest
from pyspark.sql import functions as F

from featloom.operators import latest as lat
from featloom.schemas import latest_name

from golden import golden_wide


def test_latest_numeric_golden(spark):
    r = lat.latest_numeric(golden_wide(spark)).first()
    assert r["clickNum10Latest1Month"] == 23.0
    assert r["clickNum9Latest2Month"] == 51.0
    assert r["clickNum8Latest3Month"] == 114.0
    assert r["orderNum8Latest3Month"] == 22.0
    assert r["orderAmount9Latest2Month"] == pytest.approx(20.8268977954, abs=1e-9)
    assert r["orderAmount8Latest3Month"] == pytest.approx(54.8337579744, abs=1e-9)
    assert r["discountAmount8Latest3Month"] == pytest.approx(23.5373557363, abs=1e-9)
    assert r["avgDiscount8Latest3Month"] == pytest.approx(3.2858685795, abs=1e-9)


def test_latest_map_golden(spark):
    r = lat.latest_map(golden_wide(spark)).first()
    assert r["clickPage10Latest1Month"] == "7:1;10:13;1:6;9:3"  # verbatim
    assert r["clickPage9Latest2Month"] == "1:8.0;10:38.0;7:2.0;9:3.0"
    assert r["clickPage8Latest3Month"] == "1:28.0;10:77.0;7:3.0;9:6.0"
    cat3 = dict(e.split(":") for e in r["amountByCateId8Latest3Month"].split(";"))
    assert float(cat3["44"]) == pytest.approx(35.3628784226, abs=1e-9)
    assert "44" not in r["amountByCateId10Latest1Month"]


def test_latest_names_order():
    names = lat.latest_columns()
    assert names[:3] == ["clickNum10Latest1Month", "clickNum9Latest2Month", "clickNum8Latest3Month"]
    assert names[24:27] == ["clickPageParam10Latest1Month", "clickPageParam9Latest2Month", "clickPageParam8Latest3Month"]
    assert len(names) == 36


def test_long_form_equals_wide_form(spark):
    w = golden_wide(spark)
    long_df = spark.createDataFrame([(38926, p, float(v)) for p, v in zip((8, 9, 10, 11), (63, 28, 23, 27))],
                                    "uid long, period int, clickNum double")
    got = {r.period: r.clickNum_latest for r in lat.latest_numeric_long(long_df, ["clickNum"]).collect()}
    wide = lat.latest_numeric(w, ["clickNum"]).first()
    assert got == {10: wide[latest_name("clickNum", 10, 1)], 9: wide[latest_name("clickNum", 9, 2)],
                   8: wide[latest_name("clickNum", 8, 3)]}


def test_attach_merge_combine(spark):
    a = spark.createDataFrame([(1, "a:1;b:2"), (2, "c:1")], "k long, m string")
    b = spark.createDataFrame([(1, "b:3;d:1"), (3, "x:1")], "k long, m string")
    merged = {r.k: r.merged for r in lat.merge_map_columns(a, b, "k", "m", "m").collect()}
    assert merged == {1: "a:1.0;b:5.0;d:1.0"}
    x = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    y = spark.createDataFrame([(1, 5.0), (3, 1.0)], "k long, v double")
    assert {r.k: r.v for r in lat.combine_sum(x, y, "k", "v").collect()} == {1: 7.0, 2: 3.0, 3: 1.0}
    att = lat.attach_column(x, y, "k", ["v"], order_by_key=True) if False else \
        lat.attach_column(x, y.withColumnRenamed("v", "w"), "k", ["w"], order_by_key=True)
    assert [(r.k, r.w) for r in att.collect()] == [(1, 5.0)]


def test_map_long_form_matches_wide(spark):
    from golden import GOLDEN
    pages = GOLDEN["clickPage"]
    long_df = spark.createDataFrame([(38926, p, s) for p, s in zip((8, 9, 10, 11), pages)],
                                    "uid long, period int, m string")
    got = {r.n: r.latest for r in lat.latest_map_long(long_df, "m").collect()}
    assert got[2] == "1:8.0;10:38.0;7:2.0;9:3.0"
    assert got[3] == "1:28.0;10:77.0;7:3.0;9:6.0"
    assert got[1] == "1:6.0;10:13.0;7:1.0;9:3.0"  # typed, unlike the wide form's verbatim n=1


def test_map_long_form_duplicates_and_gaps(spark):
    long_df = spark.createDataFrame([(1, 9, "a:1;a:4;b:"), (2, 8, "z:2")], "uid long, period int, m string")
    got = {(r.uid, r.n): r.latest for r in lat.latest_map_long(long_df, "m").collect()}
    # uid 1 has nothing in period 10: n=1 absent; the duplicate a keeps its last value; "b:" is malformed
    assert got == {(1, 2): "a:4.0", (1, 3): "a:4.0", (2, 3): "z:2.0"}
