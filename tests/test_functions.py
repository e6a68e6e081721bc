from pyspark.sql import functions as F

from featloom.functions.hashing import (java_hash_bucket, java_hash_bucket_col, java_string_hash,
                                        sha1_bucket, sha1_bucket_col)
from featloom.functions.mapstr import merge_maps, pack_map, unpack_map, map_entries_text
from featloom.functions.dates import year_month_text, period_of


def one(spark, expr, data=None, schema="s string"):
    df = spark.createDataFrame(data or [("x",)], schema)
    return df.select(expr.alias("r")).collect()[0]["r"]


# Golden buckets (FIXTURES.md section 3).
JAVA = {"age35": 705, "sex1": 795, "limit": 443, "clickNum_1": 464, "clickNum_2": 463, "clickNum_3": 462,
        "orderNum_1": 922, "orderNum_2": 923, "orderNum_3": 924, "orderAmount_1": 208, "orderAmount_2": 209,
        "orderAmount_3": 210, "loanNum_1": 856, "loanNum_2": 857, "loanNum_3": 858, "loanAmount_1": 886,
        "loanAmount_2": 885, "loanAmount_3": 884}
SHA1 = {"age\t35": 128, "sex\t1": 629, "limit": 893, "click_num": 120, "order_num": 492, "order_sum": 445,
        "loan_num": 951, "loan_sum": 76}


def test_java_buckets_driver():
    for k, b in JAVA.items():
        assert java_hash_bucket(k) == b, k
    assert java_string_hash("") == 0
    assert java_string_hash("Aa") == java_string_hash("BB")


def test_java_buckets_column(spark):
    df = spark.createDataFrame([("35",), ("1",)], "v string")
    got = [r[0] for r in df.select(java_hash_bucket_col("v", prefix="age")).collect()]
    assert got == [705, java_hash_bucket("age1")]
    df2 = spark.createDataFrame([(k,) for k in JAVA], "k string")
    assert [r[0] for r in df2.select(java_hash_bucket_col("k")).collect()] == list(JAVA.values())


def test_java_bucket_negative_hash(spark):
    # a key whose hash is negative still gives a non-negative bucket
    keys = ["polygenelubricants", "zzzzzzzzzz", "hello world"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(java_hash_bucket_col("k")).collect()]
    assert got == [abs(java_string_hash(k)) % 1000 for k in keys]


def test_sha1_buckets(spark):
    for k, b in SHA1.items():
        assert sha1_bucket(k) == b
    df = spark.createDataFrame([(k,) for k in SHA1], "k string")
    assert [r[0] for r in df.select(sha1_bucket_col("k")).collect()] == list(SHA1.values())
    df = spark.createDataFrame([("35",)], "v string")
    assert df.select(sha1_bucket_col("v", prefix="age\t")).first()[0] == 128


def test_pack_unpack_roundtrip(spark):
    s = "1:2.0;10:38.0;7:2.0;9:3.0"
    assert one(spark, pack_map(unpack_map(F.lit(s)))) == s
    assert one(spark, pack_map(unpack_map(F.lit("")))) == ""


def test_unpack_last_wins_and_malformed(spark):
    m = one(spark, unpack_map(F.lit("a:1;b:2;a:5;7:;x")))
    assert m == {"a": 5.0, "b": 2.0}
    # trailing separators stripped in the merge dialect: "a:b:" is (a, b)
    m = one(spark, unpack_map(F.lit("k:3:"), value_type="string"))
    assert m == {"k": "3"}


def test_entries_python_dialect(spark):
    got = one(spark, map_entries_text(F.lit("7:;a:b:;c:2"), strip_trailing=False))
    assert [(e["key"], e["value"]) for e in got] == [("7", ""), ("c", "2")]
    got = one(spark, map_entries_text(F.lit("7:;a:b:;c:2"), strip_trailing=True))
    assert [(e["key"], e["value"]) for e in got] == [("a", "b"), ("c", "2")]


def test_merge_maps(spark):
    m = one(spark, pack_map(merge_maps(unpack_map(F.lit("7:1;10:13;1:6;9:3")), unpack_map(F.lit("7:1;1:2;10:25"))))) 
    assert m == "1:8.0;10:38.0;7:2.0;9:3.0"


def test_dates(spark):
    df = spark.createDataFrame([("2016-01-05",)], "d string").select(F.to_date("d").alias("d"))
    r = df.select(year_month_text("d").alias("a"), period_of("d", "month").alias("m"),
                  period_of("d", "week").alias("w")).first()
    assert (r.a, r.m, r.w) == ("2016-1", 1, 1)


def test_numeric_helpers(spark):
    from featloom.functions.numeric import clamp_zero, empty_to, safe_ratio, squared_error
    df = spark.createDataFrame([("", 3.0, 0), ("2.5", -1.0, 2)], "s string, x double, d int")
    rows = df.select(empty_to("s", "-1").alias("e"), clamp_zero("x").alias("c"), safe_ratio("x", "d").alias("r"),
                     squared_error("x", F.lit(1.0)).alias("q")).collect()
    assert [(r.e, r.c, r.r, r.q) for r in rows] == [("-1", 3.0, None, 4.0), ("2.5", 0.0, -0.5, 4.0)]


def test_non_numeric_map_value_fails(spark):
    import pytest
    df = spark.createDataFrame([("a:1;b:x",)], "s string")
    with pytest.raises(Exception):
        df.select(unpack_map("s").alias("m")).collect()


def test_repeated_map_keys_stay_cheap(spark):
    text = ";".join(f"7:{i}" for i in range(20_000))
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(unpack_map("s").alias("m")).first().m == {"7": 19999.0}
    assert df.select(unpack_map(F.col("s")).alias("m")).first().m == {"7": 19999.0}


def test_java_buckets_of_surrogate_pairs(spark):
    from pyspark.sql import functions as F

    from featloom.functions import hashing as h

    texts = ["😀", "a😀b", "𝐀𠀀", "￿", "\U00010000", "\U0010ffff", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select("v", h.java_hash_bucket_col("v", "slot").alias("a"), h.java_hash_bucket_col(F.col("v"), "slot").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(h.java_hash_bucket("slot" + t),) * 2 for t in texts]
