"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the given tables through the adapters in ``tables.py`` and
runs over whole tables.  Numeric outputs are cast to double (or bigint) at the
very end so results compare exactly with the SQL oracle; inside, decimal sums
stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.operators import boosting as gbt
from featloom.operators import encode as enc
from featloom.operators import latest as lat
from featloom.operators import model as mdl
from featloom.operators import moments as mom
from featloom.operators import nested as nst
from featloom.operators import periods as per
from featloom.operators import positions as pos
from featloom.operators import samples as smp
from featloom.operators import snapshot as snp
from featloom.operators.store import PeriodStore
from featloom.plans import tables as t
from featloom.schemas import (CLICK_METRICS, CLICK_SCHEMA, DEFAULT_PERIODS, LOAN_METRICS, LOAN_SCHEMA,
                              LOAN_SUM_CSV_SCHEMA, USER_SCHEMA, period_columns)
from featloom.functions.dates import ymd_text
from featloom.sources import csv as csvsrc
from featloom.sources.specs import parse_dictionary
from featloom.session import scratch_path
from featloom.sources.text import parse_delimited

WEEKS = (1, 2, 3, 4)
DOUBLE_METRICS = ("orderAmount", "discountAmount", "loanAmount")


def _doubles(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def _wide(spark: SparkSession, sf: str, periods=DEFAULT_PERIODS) -> DataFrame:
    return per.wide_features(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf),
                             t.loans(spark, sf), t.loan_sums(spark, sf), periods,
                             per_plan_type=t.PER_PLAN)


def monthly_order_features(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: orders -> A7-A9 per (uid, month 8-11) -> densified onto users."""
    of = per.order_features(t.orders(spark, sf), DEFAULT_PERIODS)
    metrics = ("orderNum", "orderAmount", "discountAmount", "avgDiscount")
    wide = per.densify(t.users(spark, sf).select("uid"), of.drop(*period_columns("amountByCateId", DEFAULT_PERIODS)),
                       metrics, DEFAULT_PERIODS)
    return _doubles(wide, [c for m in ("orderAmount", "discountAmount") for c in period_columns(m, DEFAULT_PERIODS)])


def order_amount_by_category(spark: SparkSession, sf: str) -> DataFrame:
    df = per.order_amount_by_category(t.orders(spark, sf), DEFAULT_PERIODS)
    return df.select("uid", F.col("period").cast("long").alias("period"), "amountByCateId")


def weekly_click_features(spark: SparkSession, sf: str) -> DataFrame:
    cf = per.click_features(t.clicks(spark, sf), WEEKS, period="week")
    return per.densify(t.users(spark, sf).select("uid"), cf, CLICK_METRICS, WEEKS)


def monthly_loan_features(spark: SparkSession, sf: str) -> DataFrame:
    lf = per.loan_features(t.loans(spark, sf), DEFAULT_PERIODS, per_plan_type=t.PER_PLAN)
    wide = per.densify(t.users(spark, sf).select("uid"), lf, LOAN_METRICS, DEFAULT_PERIODS)
    return _doubles(wide, period_columns("loanAmount", DEFAULT_PERIODS))


def raw_feature_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide_doubles(_wide(spark, sf))


def _wide_doubles(w: DataFrame) -> DataFrame:
    dbl = ["limit", "loanSum"] + [c for m in DOUBLE_METRICS for c in period_columns(m, DEFAULT_PERIODS)]
    return _doubles(w, dbl).withColumn("active_date", F.col("active_date").cast("string"))


def raw_feature_line(spark: SparkSession, sf: str) -> DataFrame:
    w = _wide(spark, sf)
    return w.select("uid", smp.raw_line(w).alias("line"))


def latest_numeric(spark: SparkSession, sf: str) -> DataFrame:
    w = _wide(spark, sf)
    out = lat.latest_numeric(w)
    return out.select("uid", *[c for c in out.columns if "Latest" in c])


def latest_map(spark: SparkSession, sf: str) -> DataFrame:
    w = _wide(spark, sf)
    out = lat.latest_map(w)
    return out.select("uid", *[c for c in out.columns if "Latest" in c])


def latest_numeric_long(spark: SparkSession, sf: str) -> DataFrame:
    """W1 long form: running order counts over months 10, 9, 8 (window per uid)."""
    fine = per.order_period_stats(t.orders(spark, sf), DEFAULT_PERIODS)
    long_df = fine.groupBy("uid", "period").agg(F.sum("n").alias("orders"))
    out = lat.latest_numeric_long(long_df, ["orders"], order=(10, 9, 8))
    return out.select("uid", F.col("period").cast("long").alias("period"), F.col("n").cast("int").alias("n"),
                      "orders_latest")


def latest_map_long(spark: SparkSession, sf: str) -> DataFrame:
    long_df = per.order_amount_by_category(t.orders(spark, sf), DEFAULT_PERIODS)
    return lat.latest_map_long(long_df, "amountByCateId", order=(10, 9, 8))


def trailing_feature_line(spark: SparkSession, sf: str) -> DataFrame:
    w = lat.latest_map(lat.latest_numeric(_wide(spark, sf)))
    return w.select("uid", smp.trailing_line(w).alias("line"))


def sample_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return smp.sample_lines(_wide(spark, sf), smp.month_sample(8, label=True))


def sample_nov(spark: SparkSession, sf: str) -> DataFrame:
    return smp.sample_lines(_wide(spark, sf), smp.month_sample(9, label="loanSum"))


def sample_dec(spark: SparkSession, sf: str) -> DataFrame:
    return smp.sample_lines(_wide(spark, sf), smp.month_sample(10, label=False))


def sample_fanout(spark: SparkSession, sf: str) -> DataFrame:
    out = smp.fanout_samples(_wide(spark, sf))
    return out.select("uid", F.col("period").cast("int").alias("period"), "line")


def _snapshot_out(df: DataFrame) -> DataFrame:
    return df.select("id", "uid", F.col("snapshot_month").cast("int").alias("snapshot_month"),
                     "n_clicks", "n_orders", F.col("order_amount").cast("double").alias("order_amount"),
                     "n_loans", F.col("loan_amount").cast("double").alias("loan_amount"),
                     F.col("loan_sum").cast("double").alias("loan_sum"))


def user_snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = snp.snapshot(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf), t.loans(spark, sf),
                     months=[10], run_id=0)
    return _snapshot_out(s)


def user_snapshot_union(spark: SparkSession, sf: str) -> DataFrame:
    s = snp.snapshot(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf), t.loans(spark, sf),
                     months=[9, 10, 11], run_id=0)
    return _snapshot_out(s)


def snapshot_order_records(spark: SparkSession, sf: str) -> DataFrame:
    o = t.orders(spark, sf).select("uid", "buy_date", "price", "number", "cate_id", "discount")
    r = snp.snapshot_records(o, "buy_date", [9, 10, 11], run_id=0)
    return _doubles(r, ["price", "discount"]).select(
        "id", "uid", F.col("snapshot_month").cast("int").alias("snapshot_month"), "buy_date", "price", "number",
        "cate_id", "discount")


def snapshot_click_records(spark: SparkSession, sf: str) -> DataFrame:
    r = snp.snapshot_records(t.clicks(spark, sf), "click_time", [9, 10, 11], run_id=0)
    return r.select("id", "uid", F.col("snapshot_month").cast("int").alias("snapshot_month"),
                    _seconds("click_time").alias("click_time"), "pid", "param")


def snapshot_loan_records(spark: SparkSession, sf: str) -> DataFrame:
    r = snp.snapshot_records(t.loans(spark, sf), "loan_time", [9, 10, 11], run_id=0)
    return _doubles(r, ["loan_amount"]).select(
        "id", "uid", F.col("snapshot_month").cast("int").alias("snapshot_month"),
        _seconds("loan_time").alias("loan_time"), "loan_amount", "plan_num")


def assembled_users(spark: SparkSession, sf: str) -> DataFrame:
    a = snp.assemble_counts(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf), t.loans(spark, sf),
                            t.loan_sums(spark, sf))
    return _doubles(a, ["order_amount", "loan_amount", "loan_sum"])


CUTOFF = "1998-11-01 00:00:00"


def cutoff_filtered_users(spark: SparkSession, sf: str) -> DataFrame:
    return snp.cutoff_counts(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf), t.loans(spark, sf),
                             CUTOFF)


def loan_label_month(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(snp.loan_label(t.users(spark, sf), t.loans(spark, sf), 11), ["loan_sum"])


def attach_column(spark: SparkSession, sf: str) -> DataFrame:
    j = lat.attach_column(t.users(spark, sf).select("uid", "age"), t.loan_sums(spark, sf), "uid", ["loan_sum"],
                          order_by_key=True)
    return _doubles(j, ["loan_sum"])


def merge_map_columns(spark: SparkSession, sf: str) -> DataFrame:
    cf = per.click_features(t.clicks(spark, sf), WEEKS, period="week")
    a = cf.where(F.col("clickNum1") > 0)
    b = cf.where(F.col("clickNum2") > 0)
    return lat.merge_map_columns(a, b, "uid", "clickPage1", "clickPage2")


def combine_sum(spark: SparkSession, sf: str) -> DataFrame:
    a = t.orders(spark, sf).groupBy("uid").agg(F.sum(per.order_amount()).alias("v"))
    b = t.loans(spark, sf).groupBy("uid").agg(F.sum("loan_amount").alias("v"))
    return _doubles(lat.combine_sum(a, b, "uid", "v", "total"), ["total"])


ORDER_LINE_SCHEMA = "uid long, buy_date date, price decimal(18,2), number int, cate_id long, discount decimal(18,4)"


def csv_parse_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = t.orders(spark, sf)
    price_txt = F.when((o.order_key + o.line_number) % 10 == 0, F.lit("")).otherwise(o.price.cast("string"))
    lines = _csv_lines(o, "uid", ymd_text("buy_date"), price_txt, "number", "cate_id", "discount")
    # The order reader's options and rules over lines; money as decimals.
    out = csvsrc.as_orders(csvsrc.parse_csv_lines(lines, ORDER_LINE_SCHEMA)).withColumn("amount", per.order_amount())
    return _doubles(out, ["price", "discount", "amount"]).select(
        "uid", "buy_date", "price", "number", "cate_id", "discount", "amount")


def _csv_lines(df: DataFrame, *fields) -> DataFrame:
    """The fields of each row as one comma line; a null is an empty field."""
    cols = [F.col(f"`{f}`") if isinstance(f, str) else f for f in fields]
    return df.select(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("value"))


def _seconds(ts: str):
    """Wall-clock text of a timestamp, to the second."""
    return F.substring(F.col(ts).cast("string"), 1, 19)


def csv_parse_users(spark: SparkSession, sf: str) -> DataFrame:
    lines = _csv_lines(t.users(spark, sf), "uid", "age", "sex", ymd_text("active_date"), "limit")
    return csvsrc.as_users(csvsrc.parse_csv_lines(lines, USER_SCHEMA))


def csv_parse_clicks(spark: SparkSession, sf: str) -> DataFrame:
    lines = _csv_lines(t.clicks(spark, sf), "uid", _seconds("click_time"), "pid", "param")
    return csvsrc.as_clicks(csvsrc.parse_csv_lines(lines, CLICK_SCHEMA)).withColumn("click_time", _seconds("click_time"))


def csv_parse_loans(spark: SparkSession, sf: str) -> DataFrame:
    lines = _csv_lines(t.loans(spark, sf), "uid", _seconds("loan_time"), "loan_amount", "plan_num")
    return csvsrc.as_loans(csvsrc.parse_csv_lines(lines, LOAN_SCHEMA)).withColumn("loan_time", _seconds("loan_time"))


def csv_parse_loan_sums(spark: SparkSession, sf: str) -> DataFrame:
    lines = _csv_lines(t.loan_sums(spark, sf), "uid", "month", "loan_sum")
    return csvsrc.as_loan_sums(csvsrc.parse_csv_lines(lines, LOAN_SUM_CSV_SCHEMA))


def delimited_users(spark: SparkSession, sf: str) -> DataFrame:
    """S8 typed side: every 7th user lacks the limit (default -1), every 11th line has a field too many (rejected)."""
    u = t.users(spark, sf)
    limit = F.when(F.col("uid") % 7 == 0, F.lit("")).otherwise(F.col("limit").cast("string"))
    line = F.when(F.col("uid") % 11 == 0, F.concat("value", F.lit(",x"))).otherwise(F.col("value"))
    lines = u.select("uid", F.concat_ws(",", "uid", "age", "sex", ymd_text("active_date"), limit).alias("value"))
    good, _bad = parse_delimited(lines.select(line.alias("value")), USER_SCHEMA, defaults={"limit": -1})
    return good


def csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    conv = t.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("value"))
    _good, bad = parse_delimited(conv, "a string, b string, c string", keep=["conv_id", "turn"])
    return bad.select("conv_id", "turn", "n_fields")


def split_train_validation(spark: SparkSession, sf: str) -> DataFrame:
    return mdl.hash_split(t.users(spark, sf).select("uid"), "uid")


def _labelled_users(spark: SparkSession, sf: str) -> DataFrame:
    u = t.users(spark, sf)
    return mdl.hash_split(snp.loan_label(u, t.loans(spark, sf), 11, keep=u.columns), "uid")


def rmse_zero_baseline(spark: SparkSession, sf: str) -> DataFrame:
    valid = _labelled_users(spark, sf).where(~F.col("is_train"))
    return mdl.rmse(valid, F.lit(0), "loan_sum")


def linreg_single_feature(spark: SparkSession, sf: str) -> DataFrame:
    xy = t.orders(spark, sf).select(F.col("number").cast("double").alias("x"),
                                    per.order_amount().cast("double").alias("y"))
    # With one feature the normal equations are aggregates: one pass, nothing stored.
    return xy.agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"),
                  F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


def linreg_full_rmse(spark: SparkSession, sf: str) -> DataFrame:
    data = mdl.numeric_user_features(_labelled_users(spark, sf).withColumn("label", F.col("loan_sum").cast("double")))
    train, valid = data.where("is_train"), data.where("not is_train")
    model = mdl.fit_linear(train, mdl.USER_FEATURES, "label")
    scored = mdl.score(model, valid, mdl.USER_FEATURES)
    # The reference scored the constant 0.0; report it next to the model.
    return mdl.rmse_many(scored, "label", {"zero": F.lit(0.0), "model": "prediction"})


def grid_sweep_rmse(spark: SparkSession, sf: str) -> DataFrame:
    data = mdl.numeric_user_features(_labelled_users(spark, sf).withColumn("label", F.col("loan_sum").cast("double")))
    results = mdl.grid_sweep(data.where("is_train"), mdl.USER_FEATURES, "label")
    rows = []
    for params, metric in results:
        named = {k.name: v for k, v in params.items()}
        rows.append((float(named["stepSize"]), float(named["minInfoGain"]), int(named["minInstancesPerNode"]),
                     int(named["maxDepth"]), float(metric)))
    return spark.createDataFrame(rows, "step_size double, min_info_gain double, min_instances int, max_depth int, rmse double")


def _exact_users(spark: SparkSession, sf: str) -> DataFrame:
    """Features and label as exact decimals, so that their sums do not depend on the partitioning."""
    data = mdl.numeric_user_features(_labelled_users(spark, sf))
    return data.select("uid", "is_train", *[F.col(f).cast(t.MONEY).alias(f) for f in mdl.USER_FEATURES], F.col("loan_sum").cast(t.MONEY).alias("label"))


def linreg_sgd_steps(spark: SparkSession, sf: str) -> DataFrame:
    """L2 as the reference trains: at most 100 steps of 1e-8 on the training side."""
    fit = mom.fit_steps(_exact_users(spark, sf).where("is_train"), mdl.USER_FEATURES, "label")
    return fit.select("n", "steps", *[F.col("weights")[i].alias(f"w_{f}") for i, f in enumerate(mdl.USER_FEATURES)], "rmse_zero", "rmse_model")


def kfold_sgd_rmse(spark: SparkSession, sf: str) -> DataFrame:
    """L1 + L2 + L3 + A13 over ten folds, all from one scan."""
    return mom.cross_validate(_exact_users(spark, sf), "uid", mdl.USER_FEATURES, "label").drop("weights")


def boosted_grid_rmse(spark: SparkSession, sf: str) -> DataFrame:
    """L4: the whole grid of 128 boosted forests, grown together and scored on the validation side."""
    data = mdl.numeric_user_features(_labelled_users(spark, sf))
    _, scored = gbt.fit_grid(data, mdl.USER_FEATURES, "loan_sum", train="is_train")
    return gbt.grid_rmse(gbt.grid(), scored)


#: Records of a kind in a chunk of the nested queries; small, so that the test tables have users of several chunks.
CHUNK = 16


def _nested(spark: SparkSession, sf: str, **options) -> DataFrame:
    return nst.nest(t.users(spark, sf), t.clicks(spark, sf), t.orders(spark, sf), t.loans(spark, sf), size=CHUNK, **options)


def nested_user_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + J1-J3 + J6: every user's records in sorted chunks, rendered as text."""
    def text(kind, *fields):
        return F.array_join(F.transform(kind, lambda r: F.concat_ws(":", *[F.coalesce(f(r), F.lit("")) for f in fields])), ";").alias(kind)

    def plain(name):
        return lambda r: r[name].cast("string")

    def time(name):
        return lambda r: F.date_format(r[name], "yyyy-MM-dd HH:mm:ss")

    n = _nested(spark, sf, loan_sums=t.loan_sums(spark, sf))
    return n.select("uid", "age", "chunk_no", text("clicks", time("click_time"), plain("pid"), plain("param")),
                    text("orders", plain("buy_date"), plain("order_key"), plain("line_number"), plain("number")),
                    text("loans", time("loan_time"), plain("loan_amount"), plain("plan_num")), F.col("loan_sum").cast("double").alias("loan_sum"))


def nested_snapshot_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """J1-J3 + F2: only records of months before October, with each chunk's sizes and time span."""
    n = _nested(spark, sf, before_month=10)
    return n.select("uid", "chunk_no", *[F.size(k).cast("long").alias(f"n_{k}") for k in nst.KINDS],
                    *[F.date_format(f"{k}_{e}", "yyyy-MM-dd HH:mm:ss").alias(f"{k}_{e}") for k in nst.KINDS for e in ("from", "to")])


def nested_cutoff_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """F4 over the stored nested table: whole chunks judged by their time columns."""
    n = nst.cut_off(nst.store(_nested(spark, sf)), CUTOFF)
    return n.select("uid", "chunk_no", *[F.size(k).cast("long").alias(f"n_{k}") for k in nst.KINDS],
                    *[F.date_format(f"{k}_to", "yyyy-MM-dd HH:mm:ss").alias(f"{k}_to") for k in nst.KINDS])


def nested_feature_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A16 over the nested table; the same rows as ``raw_feature_wide``."""
    n = nst.store(_nested(spark, sf, loan_sums=t.loan_sums(spark, sf)))
    return _wide_doubles(nst.wide_features(n, per_plan_type=t.PER_PLAN))


def store_feature_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide row from a period store grown month by month; a part of month 9 arrives two months late."""
    store = PeriodStore(spark, scratch_path(spark, "period-store"), per_plan_type=t.PER_PLAN)
    frames = {"clicks": (t.clicks(spark, sf), "click_time"), "orders": (t.orders(spark, sf), "buy_date"), "loans": (t.loans(spark, sf), "loan_time")}
    late = (F.col("uid") % 7 == 0)
    for m in DEFAULT_PERIODS:
        month = {k: F.month(ts) for k, (_, ts) in frames.items()}
        due = {k: df.where(((month[k] == m) & ~((month[k] == 9) & late)) | ((month[k] == 9) & late & F.lit(m == 11))) for k, (df, _) in frames.items()}
        store.add(f"month-{m}", **due)
    return _wide_doubles(store.wide(t.users(spark, sf), {k: df for k, (df, _) in frames.items()}, t.loan_sums(spark, sf)))


def attach_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """R5 + J7 by row position: row i of the users gets the amount of row i of the loans in time order."""
    users = t.users(spark, sf).select("uid", "age")
    loans = t.loans(spark, sf).select("loan_time", F.col("uid").alias("loan_uid"), "loan_amount", "plan_num")
    out = pos.attach_by_position(users, loans, ["loan_uid", "loan_amount"], ["uid"], ["loan_time", "loan_uid", "loan_amount", "plan_num"])
    return out.select("pos", "uid", "age", "loan_uid", F.col("loan_amount").cast("double").alias("loan_amount"))


# Encoder over one row per user: label loan_sum, discrete age/sex, a page map, a count.
ENCODER_SPEC = enc.FeatureSpec(["uid", "age_d", "sex_d", "page_m", "n_orders", "loan_sum"], "loan_sum",
                               ["uid", "sex_d"])


def encoder_rows(spark: SparkSession, sf: str) -> DataFrame:
    from featloom.functions.mapstr import pack_entries
    c = t.clicks(spark, sf).groupBy("uid", "pid").agg(F.count(F.lit(1)).alias("n"))
    pages = c.groupBy("uid").agg(pack_entries(F.collect_list(F.struct(F.col("pid").cast("string").alias("key"),
                                                                       F.col("n").alias("value")))).alias("page_m"))
    n_orders = t.orders(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n_orders"))
    u = t.users(spark, sf)
    j = (u.join(pages, "uid", "left").join(n_orders, "uid", "left").join(t.loan_sums(spark, sf), "uid", "left"))
    return j.select("uid", F.col("age").alias("age_d"), F.col("sex").alias("sex_d"),
                    F.coalesce("page_m", F.lit("")).alias("page_m"),
                    F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"),
                    F.coalesce("loan_sum", F.lit(0)).alias("loan_sum"))


def encode_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    entries = enc.feature_entries(encoder_rows(spark, sf), ENCODER_SPEC, row_id="uid")
    return enc.build_dictionary(entries, row_id="uid")


def encode_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = encoder_rows(spark, sf)
    d = enc.build_dictionary(enc.feature_entries(rows, ENCODER_SPEC, row_id="uid"), row_id="uid")
    return enc.encode_lines(rows, ENCODER_SPEC, d, row_id="uid")


def encode_with_existing(spark: SparkSession, sf: str) -> DataFrame:
    """M10 grown from ``key:id`` lines rendered from the clicks.

    Each click gives a line for its page, with an older id before the valid one
    and malformed lines between; the ids have gaps.
    """
    c = t.clicks(spark, sf).where("pid IS NOT NULL")
    lines = c.select("pid", F.explode(F.expr(
        "array(named_struct('n', 1, 'value', concat(' page_m_', pid, ':', pid)), "
        "named_struct('n', 2, 'value', concat('page_m_', pid, ':', pid * 10, '\\t')), "
        "named_struct('n', 3, 'value', concat('page_m_', pid)), "
        "named_struct('n', 4, 'value', concat('page_m_', pid, ':9:9')))")).alias("l")).select("l.n", "l.value")
    existing = parse_dictionary(lines, "n")
    entries = enc.feature_entries(encoder_rows(spark, sf), ENCODER_SPEC, row_id="uid")
    return enc.build_dictionary(entries, row_id="uid", existing=existing)


QUERIES = {
    "monthly_order_features": monthly_order_features,
    "order_amount_by_category": order_amount_by_category,
    "weekly_click_features": weekly_click_features,
    "monthly_loan_features": monthly_loan_features,
    "raw_feature_wide": raw_feature_wide,
    "raw_feature_line": raw_feature_line,
    "user_snapshot_counts": user_snapshot_counts,
    "user_snapshot_union": user_snapshot_union,
    "snapshot_order_records": snapshot_order_records,
    "assembled_users": assembled_users,
    "cutoff_filtered_users": cutoff_filtered_users,
    "loan_label_month": loan_label_month,
    "latest_numeric": latest_numeric,
    "latest_map": latest_map,
    "latest_numeric_long": latest_numeric_long,
    "latest_map_long": latest_map_long,
    "sample_by_month": sample_by_month,
    "sample_nov": sample_nov,
    "sample_dec": sample_dec,
    "sample_fanout": sample_fanout,
    "encode_dictionary": encode_dictionary,
    "encode_lines": encode_lines,
    "encode_with_existing": encode_with_existing,
    "snapshot_click_records": snapshot_click_records,
    "snapshot_loan_records": snapshot_loan_records,
    "csv_parse_users": csv_parse_users,
    "csv_parse_clicks": csv_parse_clicks,
    "csv_parse_loans": csv_parse_loans,
    "csv_parse_loan_sums": csv_parse_loan_sums,
    "delimited_users": delimited_users,
    "csv_parse_orders": csv_parse_orders,
    "trailing_feature_line": trailing_feature_line,
    "attach_column": attach_column,
    "merge_map_columns": merge_map_columns,
    "combine_sum": combine_sum,
    "csv_rejects": csv_rejects,
    "split_train_validation": split_train_validation,
    "rmse_zero_baseline": rmse_zero_baseline,
    "linreg_single_feature": linreg_single_feature,
    "linreg_full_rmse": linreg_full_rmse,
    "grid_sweep_rmse": grid_sweep_rmse,
    "linreg_sgd_steps": linreg_sgd_steps,
    "kfold_sgd_rmse": kfold_sgd_rmse,
    "boosted_grid_rmse": boosted_grid_rmse,
    "nested_user_chunks": nested_user_chunks,
    "nested_snapshot_chunks": nested_snapshot_chunks,
    "nested_cutoff_chunks": nested_cutoff_chunks,
    "nested_feature_wide": nested_feature_wide,
    "store_feature_wide": store_feature_wide,
    "attach_by_position": attach_by_position,
}


def oracle_sql() -> dict[str, str]:
    from featloom.plans import oracle as o
    return {
        "monthly_order_features": o.monthly_order_features(),
        "order_amount_by_category": o.order_amount_by_category(),
        "weekly_click_features": o.weekly_click_features(),
        "monthly_loan_features": o.monthly_loan_features(),
        "raw_feature_wide": o.raw_feature_wide(),
        "raw_feature_line": o.raw_feature_line(),
        "user_snapshot_counts": o.user_snapshot([10]),
        "user_snapshot_union": o.user_snapshot([9, 10, 11]),
        "snapshot_order_records": o.snapshot_order_records(),
        "assembled_users": o.assembled_users(),
        "cutoff_filtered_users": o.cutoff_filtered_users(CUTOFF),
        "loan_label_month": o.loan_label_month(11),
        "latest_numeric": o.latest_numeric(),
        "latest_map": o.latest_map(),
        "latest_numeric_long": o.latest_numeric_long(),
        "latest_map_long": o.latest_map_long(),
        "sample_by_month": o.sample_by_month(),
        "sample_nov": o.sample_nov(),
        "sample_dec": o.sample_dec(),
        "sample_fanout": o.sample_fanout(),
        "encode_dictionary": o.encode_dictionary(),
        "encode_lines": o.encode_lines(),
        "encode_with_existing": o.encode_with_existing(),
        "snapshot_click_records": o.snapshot_click_records(),
        "snapshot_loan_records": o.snapshot_loan_records(),
        "csv_parse_users": o.csv_parse_users(),
        "csv_parse_clicks": o.csv_parse_clicks(),
        "csv_parse_loans": o.csv_parse_loans(),
        "csv_parse_loan_sums": o.csv_parse_loan_sums(),
        "delimited_users": o.delimited_users(),
        "csv_parse_orders": o.csv_parse_orders(),
        "trailing_feature_line": o.trailing_feature_line(),
        "attach_column": o.attach_column(),
        "merge_map_columns": o.merge_map_columns(),
        "combine_sum": o.combine_sum(),
        "csv_rejects": o.csv_rejects(3),
        "split_train_validation": o.split_train_validation(),
        "rmse_zero_baseline": o.rmse_zero_baseline(),
        "linreg_single_feature": o.linreg_single_feature(),
        "linreg_sgd_steps": o.linreg_sgd_steps(),
        "kfold_sgd_rmse": o.kfold_sgd_rmse(),
        "nested_user_chunks": o.nested_user_chunks(CHUNK),
        "nested_snapshot_chunks": o.nested_snapshot_chunks(CHUNK),
        "nested_cutoff_chunks": o.nested_cutoff_chunks(CHUNK, CUTOFF),
        "nested_feature_wide": o.raw_feature_wide(),
        "store_feature_wide": o.raw_feature_wide(),
        "attach_by_position": o.attach_by_position(),
    }
