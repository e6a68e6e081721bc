"""Per-period behaviour aggregates and the wide per-user row.

Plan shape (checked with ``explain``): every behaviour table is aggregated at
its finest key ``(uid, period[, sub-key])`` first, so the only shuffle over raw
rows carries map-side partial aggregates; a user with a third of all rows
becomes a handful of rows per map task.  What follows (packing maps, laying
periods out as columns) groups by ``uid`` over those small rows, and the
per-user frames are hash-partitioned by ``uid``, so the left joins to the
user table reuse that partitioning instead of re-shuffling features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.functions.dates import period_of, period_range
from featloom.functions.mapstr import pack_entries_sql
from featloom.functions.numeric import clamp_zero, safe_ratio
from featloom.schemas import (CLICK_METRICS, DEFAULT_PERIODS, LOAN_METRICS, ORDER_METRICS,
                              USER_COLUMNS, period_columns)


def _period_col(period, ts_col: str) -> Column:
    return period if isinstance(period, Column) else period_of(ts_col, period)


def _in_periods(df: DataFrame, period, ts_col: str, periods) -> DataFrame:
    """Rows of ``periods``; year-aware periods also get a pushable range filter."""
    rng = None if isinstance(period, Column) else period_range(ts_col, period, list(periods))
    return df if rng is None else df.where(rng)


def _packed_sql(sel: str, key: str, value: str, agg: str = "collect_list") -> str:
    """Packed ``key:value`` map of the rows selected by ``sel`` inside a group.

    ``collect_set`` de-duplicates rows that repeat a (key, value) pair, e.g.
    a page total carried by every param row of that page.
    """
    return pack_entries_sql(f"{agg}(CASE WHEN {sel} THEN named_struct('key', {key}, 'value', {value}) END)")


def _sum_sql(sel: str, value: str, zero: str = "0") -> str:
    return f"coalesce(sum(CASE WHEN {sel} THEN {value} END), {zero})"


def click_features(clicks: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                   ts_col: str = "click_time") -> DataFrame:
    """A3-A6 per user: click count and three packed count maps per period.

    Output: ``uid, clickNum{p}, clickPage{p}, clickPageParam{p}, clickParam{p}``
    for users with at least one click in ``periods``; hash-partitioned by uid.
    """
    return click_wide(click_period_counts(clicks, periods, period, ts_col), periods)


def click_period_counts(clicks: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                        ts_col: str = "click_time") -> DataFrame:
    """Clicks per ``(uid, period, pid, param)``: the finest grain."""
    periods = list(periods)
    base = (_in_periods(clicks, period, ts_col, periods)
            .select("uid", _period_col(period, ts_col).alias("period"), "pid", "param")
            .where(F.col("period").isin(periods)))
    return base.groupBy("uid", "period", "pid", "param").agg(F.count(F.lit(1)).alias("n"))


def click_wide(counts: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS) -> DataFrame:
    """A3-A6 per user from click counts of the finest grain."""
    periods = list(periods)
    # One scan and one shuffle of raw rows (map-side partial counts at the
    # finest key), then one small shuffle re-keying those counts by uid.  The
    # per-page and per-param totals are window sums inside the uid partitions
    # (uid partitioning satisfies both windows and the final aggregate), so
    # raw rows are hashed once and no further exchange is planned.
    fine = counts.select("uid", "period", "pid", "param", "n").repartition("uid")
    fine = fine.select(
        "*",
        F.sum("n").over(Window.partitionBy("uid", "period", "pid")).alias("n_page"),
        F.sum("n").over(Window.partitionBy("uid", "period", "param")).alias("n_param"))
    # A null page or param is an empty key, so that map totals add up to the count.
    pair = "concat(coalesce(cast(pid AS string), ''), '_', coalesce(cast(param AS string), ''))"
    aggs = []
    for p in periods:
        at = f"period = {p}"
        aggs += [
            F.expr(_sum_sql(at, "n", "0L")).alias(f"clickNum{p}"),
            F.expr(_packed_sql(at, "cast(pid AS string)", "n_page", agg="collect_set")).alias(f"clickPage{p}"),
            F.expr(_packed_sql(at, pair, "n")).alias(f"clickPageParam{p}"),
            F.expr(_packed_sql(at, "cast(param AS string)", "n_param", agg="collect_set")).alias(f"clickParam{p}"),
        ]
    out = fine.groupBy("uid").agg(*aggs)
    cols = ["uid"] + [c for m in CLICK_METRICS for c in period_columns(m, periods)]
    return out.select(*cols)


def order_amount(price="price", number="number", discount="discount") -> Column:
    """A8 per order: ``max(price * number - discount, 0)``."""
    return clamp_zero(F.col(price) * F.col(number) - F.col(discount))


def order_period_stats(orders: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                       date_col: str = "buy_date") -> DataFrame:
    """Order aggregates per ``(uid, period, cate_id)``: the finest grain."""
    base = (_in_periods(orders, period, date_col, periods)
            .select("uid", _period_col(period, date_col).alias("period"), "cate_id",
                          order_amount().alias("amount"), "discount")
            .where(F.col("period").isin(list(periods))))
    return base.groupBy("uid", "period", "cate_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum("discount").alias("discount"))


def order_amount_by_category(orders: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS,
                             period="month", date_col: str = "buy_date") -> DataFrame:
    """A10 in long form: ``uid, period, amountByCateId`` packed ``cate:amount``."""
    fine = order_period_stats(orders, periods, period, date_col)
    return fine.groupBy("uid", "period").agg(
        F.expr(_packed_sql("true", "cast(cate_id AS string)", "amount")).alias("amountByCateId"))


def order_features(orders: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                   date_col: str = "buy_date") -> DataFrame:
    """A7-A10 per user: count, amount, discount total, mean discount, amount by category.

    Sums keep the input type (exact for decimals); the mean is a double ratio
    of the discount total over the order count.
    """
    return order_wide(order_period_stats(orders, periods, period, date_col), periods)


def order_wide(fine: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS) -> DataFrame:
    """A7-A10 per user from order aggregates of the finest grain."""
    periods = list(periods)
    aggs = []
    for p in periods:
        at = f"period = {p}"
        aggs += [
            F.expr(_sum_sql(at, "n", "0L")).alias(f"orderNum{p}"),
            F.expr(_sum_sql(at, "amount")).alias(f"orderAmount{p}"),
            F.expr(_sum_sql(at, "discount")).alias(f"discountAmount{p}"),
            F.expr(_packed_sql(at, "cast(cate_id AS string)", "amount")).alias(f"amountByCateId{p}"),
        ]
    per_user = fine.groupBy("uid").agg(*aggs)
    avg = {f"avgDiscount{p}": F.expr(f"CASE WHEN orderNum{p} > 0 THEN cast(discountAmount{p} AS double) / orderNum{p} "
                                     f"ELSE 0D END") for p in periods}
    cols = ["uid"] + [c for m in ORDER_METRICS for c in period_columns(m, periods)]
    return per_user.select(*[avg[c].alias(c) if c in avg else F.col(c) for c in cols])


def loan_features(loans: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                  ts_col: str = "loan_time", per_plan_type: str | None = None) -> DataFrame:
    """A11-A12 per user: loan count, total and mean instalment per period.

    ``avgLoanPerPlan = sum(amount / plan_num) / count``; a zero plan adds
    nothing to the sum but still counts (SURVEY D7).  ``per_plan_type``
    (e.g. ``decimal(18,6)``) fixes the per-loan quotient's type so decimal
    inputs sum exactly.  One shuffle, map-side combined.
    """
    periods = list(periods)
    q = safe_ratio(F.col("loan_amount"), F.col("plan_num"))
    if per_plan_type:
        q = q.cast(per_plan_type)
    base = (_in_periods(loans, period, ts_col, periods)
            .select("uid", _period_col(period, ts_col).alias("period"), "loan_amount", q.alias("q"))
            .where(F.col("period").isin(periods)))
    return _loan_wide(base, periods, lambda at: f"count(CASE WHEN {at} THEN 1 END)")


def loan_period_stats(loans: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month",
                      ts_col: str = "loan_time", per_plan_type: str | None = None) -> DataFrame:
    """Loan aggregates per ``(uid, period)``: count, total and sum of instalments."""
    q = safe_ratio(F.col("loan_amount"), F.col("plan_num"))
    base = (_in_periods(loans, period, ts_col, periods)
            .select("uid", _period_col(period, ts_col).alias("period"), "loan_amount",
                    (q.cast(per_plan_type) if per_plan_type else q).alias("q"))
            .where(F.col("period").isin(list(periods))))
    return base.groupBy("uid", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loan_amount").alias("loan_amount"), F.sum("q").alias("q"))


def loan_wide(fine: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS) -> DataFrame:
    """A11-A12 per user from loan aggregates per period."""
    return _loan_wide(fine, list(periods), lambda at: _sum_sql(at, "n", "0L"))


def _loan_wide(rows: DataFrame, periods: Sequence[int], count_sql) -> DataFrame:
    aggs = []
    for p in periods:
        at = f"period = {p}"
        aggs += [
            F.expr(count_sql(at)).alias(f"loanNum{p}"),
            F.expr(_sum_sql(at, "loan_amount")).alias(f"loanAmount{p}"),
            F.expr(_sum_sql(at, "q")).alias(f"_q{p}"),
        ]
    per_user = rows.groupBy("uid").agg(*aggs)
    avg = {f"avgLoanPerPlan{p}": F.expr(f"CASE WHEN loanNum{p} > 0 THEN cast(_q{p} AS double) / loanNum{p} ELSE 0D END")
           for p in periods}
    cols = ["uid"] + [c for m in LOAN_METRICS for c in period_columns(m, periods)]
    return per_user.select(*[avg[c].alias(c) if c in avg else F.col(c) for c in cols])


def metric_default_sql(metric: str) -> str:
    """R1 defaults of an absent period: ``0`` counts, ``0`` sums, ``""`` maps."""
    if metric in ("clickPage", "clickPageParam", "clickParam", "amountByCateId"):
        return "''"
    if metric.startswith("avg"):
        return "0D"
    return "0"


def metric_default(metric: str) -> Column:
    return F.expr(metric_default_sql(metric))


def _filled(c: str, metric: str) -> Column:
    return F.expr(f"coalesce(`{c}`, {metric_default_sql(metric)})").alias(c)


def densify(users: DataFrame, features: DataFrame, metrics: Sequence[str],
            periods: Sequence[int] = DEFAULT_PERIODS, key: str = "uid") -> DataFrame:
    """Left-join per-user features to users; absent periods get defaults."""
    cols = [c for c in features.columns if c != key]
    j = users.join(features, key, "left")
    out = [F.col(c) for c in users.columns]
    for m in metrics:
        for c in period_columns(m, periods):
            out.append(_filled(c, m))
    extra = [c for c in cols if not any(c in period_columns(m, periods) for m in metrics)]
    return j.select(*out, *[F.col(c) for c in extra])


def wide_features(users: DataFrame, clicks: DataFrame, orders: DataFrame, loans: DataFrame,
                  loan_sums: DataFrame | None = None, periods: Sequence[int] = DEFAULT_PERIODS,
                  period="month", click_period=None, per_plan_type: str | None = None) -> DataFrame:
    """A16 + P3: one row per user with every metric laid out over ``periods``.

    Column order follows the reference's wide row: user scalars, the 12
    period groups, ``loanSum`` (from ``loan_sums`` by a plain left join, so a
    duplicated uid there duplicates the user, SURVEY D19; 0 when absent).
    """
    periods = list(periods)
    cf = click_features(clicks, periods, click_period or period)
    of = order_features(orders, periods, period)
    lf = loan_features(loans, periods, period, per_plan_type=per_plan_type)
    return join_wide(users, cf, of, lf, loan_sums, periods)


def join_wide(users: DataFrame, cf: DataFrame, of: DataFrame, lf: DataFrame, loan_sums: DataFrame | None = None,
              periods: Sequence[int] = DEFAULT_PERIODS) -> DataFrame:
    """The wide row from the per-user frames of clicks, orders and loans."""
    u = users.select(*USER_COLUMNS)
    j = u.join(cf, "uid", "left").join(of, "uid", "left").join(lf, "uid", "left")
    if loan_sums is not None:
        j = j.join(loan_sums.select("uid", F.col("loan_sum").alias("_loan_sum")), "uid", "left")
        loan_sum = F.coalesce(F.col("_loan_sum"), F.lit(0)).alias("loanSum")
    else:
        loan_sum = F.lit(0.0).alias("loanSum")
    out = [F.col(c) for c in USER_COLUMNS]
    for m in CLICK_METRICS + ORDER_METRICS + LOAN_METRICS:
        out += [_filled(c, m) for c in period_columns(m, periods)]
    return j.select(*out, loan_sum)


def period_arrays(wide: DataFrame, metrics: Sequence[str], periods: Sequence[int] = DEFAULT_PERIODS,
                  keep: Sequence[str] = USER_COLUMNS + ("loanSum",)) -> DataFrame:
    """R2 inverse of P3: each metric as one array column over ``periods``."""
    arrays = [F.array(*[F.col(c) for c in period_columns(m, periods)]).alias(m) for m in metrics]
    return wide.select(*[F.col(c) for c in keep if c in wide.columns], *arrays)
