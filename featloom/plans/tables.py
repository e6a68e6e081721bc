"""Adapters: the driver's test tables seen as the five behaviour tables.

Each adapter is a projection (plus the orders x lineitem x part join) over
Parquet scans, so column pruning and filters reach the files.  Money is
``decimal(18,2)`` so sums are exact in Spark and in the SQL oracle alike; the
operators accept double columns just as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Per-loan instalment type: keeps ``amount / plan_num`` exact to 6 places.
PER_PLAN = "decimal(18,6)"


# Declared schemas of the test tables the adapters read: a given schema skips
# the footer-inference job ``spark.read.parquet`` runs per call.
TABLE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("uid"),
        (F.lit(18) + k % 50).cast("int").alias("age"),
        (F.lit(1) + k % 2).cast("int").alias("sex"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 700).cast("int")).alias("active_date"),
        F.col("c_acctbal").cast(MONEY).alias("limit"))


# Event type -> page id.
PAGE_IDS = {"click": 1, "view": 2, "purchase": 3, "signup": 4, "error": 5}
# Least number of days that a click lies before its event, and the spread of that number.
DAYS_BACK = (9100, 700)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pid = F.lit(None).cast("long")
    for name, i in reversed(list(PAGE_IDS.items())):
        pid = F.when(F.col("event_type") == name, F.lit(i).cast("long")).otherwise(pid)
    # The events lie in one month; moved back by a number of days that follows the
    # event id, they cover the feature months and both sides of the order dates' end.
    back = F.expr(f"ts - make_dt_interval(cast({DAYS_BACK[0]} + event_id % {DAYS_BACK[1]} AS int))")
    return e.select(F.col("user_id").alias("uid"), back.alias("click_time"), pid.alias("pid"),
                    F.get_json_object("props", "$.k").cast("long").alias("param"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: orders x lineitem x part."""
    # Per-order and per-part columns are typed on their own (smaller) sides,
    # once per order / part, before the join multiplies them by line items.
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("uid"), F.col("o_orderdate").cast("date").alias("buy_date"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_discount")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice").cast(MONEY).alias("price"), F.col("p_size").cast("long").alias("cate_id"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        "uid", "buy_date", "price",
        F.col("l_quantity").cast("int").alias("number"),
        "cate_id",
        (F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast(MONEY)).cast("decimal(18,4)").alias("discount"),
        F.col("o_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"))


# Plan length by ``o_orderkey % 4``.
PLAN_BY_MOD = (1, 3, 6, 12)


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    plan = F.element_at(F.array(*[F.lit(v) for v in PLAN_BY_MOD]), (F.col("o_orderkey") % 4).cast("int") + 1)
    return o.select(F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("loan_time"),
                    F.col("o_totalprice").cast(MONEY).alias("loan_amount"), plan.cast("int").alias("plan_num"))


def loan_sums(spark: SparkSession, sf_dir: str, month: int = 11) -> DataFrame:
    """The loan-sum table: per uid, the total of month ``month`` (any year)."""
    ln = loans(spark, sf_dir).where(F.month("loan_time") == month)
    return ln.groupBy("uid").agg(F.lit(month).alias("month"), F.sum("loan_amount").alias("loan_sum"))
