"""Input schemas of the five behaviour tables and the wide-row layout."""

from __future__ import annotations

from pyspark.sql import types as T

USER_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("sex", T.IntegerType()),
    T.StructField("active_date", T.DateType()),
    T.StructField("limit", T.DoubleType()),
])

CLICK_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("click_time", T.TimestampNTZType()),
    T.StructField("pid", T.LongType()),
    T.StructField("param", T.LongType()),
])

ORDER_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("buy_date", T.DateType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("number", T.IntegerType()),
    T.StructField("cate_id", T.LongType()),
    T.StructField("discount", T.DoubleType()),
])

LOAN_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("loan_time", T.TimestampNTZType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("plan_num", T.IntegerType()),
])

# The loan-sum CSV carries a month column that is read and ignored.
LOAN_SUM_CSV_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("month", T.StringType()),
    T.StructField("loan_sum", T.DoubleType()),
])

LOAN_SUM_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("loan_sum", T.DoubleType()),
])

# The wide row's metric groups in output order, and the default
# period list (months of the year) they are laid out over.
DEFAULT_PERIODS = (8, 9, 10, 11)
CLICK_METRICS = ("clickNum", "clickPage", "clickPageParam", "clickParam")
ORDER_METRICS = ("orderNum", "orderAmount", "discountAmount", "avgDiscount", "amountByCateId")
LOAN_METRICS = ("loanNum", "loanAmount", "avgLoanPerPlan")
WIDE_METRICS = CLICK_METRICS + ORDER_METRICS + LOAN_METRICS
MAP_METRICS = ("clickPage", "clickPageParam", "clickParam", "amountByCateId")
USER_COLUMNS = ("uid", "age", "sex", "active_date", "limit")

# The trailing groups and their order in the 90-column row.
TRAILING_NUMERIC = ("clickNum", "orderNum", "orderAmount", "discountAmount", "avgDiscount",
                    "loanNum", "loanAmount", "avgLoanPerPlan")
TRAILING_MAPS = ("clickPageParam", "clickPage", "clickParam", "amountByCateId")
DEFAULT_LATEST = (10, 9, 8)


def period_columns(metric: str, periods) -> list[str]:
    return [f"{metric}{p}" for p in periods]


def wide_columns(periods=DEFAULT_PERIODS) -> list[str]:
    cols = list(USER_COLUMNS)
    for m in WIDE_METRICS:
        cols += period_columns(m, periods)
    cols.append("loanSum")
    return cols


def latest_name(metric: str, period, n: int) -> str:
    return f"{metric}{period}Latest{n}Month"


_TEXT_TYPES = {"clickNum": "long", "orderNum": "long", "loanNum": "long", "clickPage": "string",
               "clickPageParam": "string", "clickParam": "string", "amountByCateId": "string"}


def wide_text_schema(periods=DEFAULT_PERIODS) -> str:
    """DDL of the wide row's text form (P2), for reading it back by name."""
    cols = ["uid long", "age int", "sex int", "active_date string", "limit double"]
    for m in WIDE_METRICS:
        cols += [f"{c} {_TEXT_TYPES.get(m, 'double')}" for c in period_columns(m, periods)]
    cols.append("loanSum double")
    return ", ".join(f"`{c.split(' ')[0]}` {c.split(' ')[1]}" for c in cols)
