"""End-to-end batch jobs with paths as arguments (the reference's entry points).

Each job reads, transforms with the operators, and writes; intermediate tables
are written to Parquet and read back, which also cuts lineage between jobs.

* ``convert_csv_tables``  CSV -> typed Parquet tables (S1-S5, K1)
* ``build_wide``          tables -> wide per-user rows (S6, A16, P3, K1)
* ``build_snapshots``     tables -> snapshot users + flat records (J5, U1, K4)
* ``trailing_text``       wide rows -> 90-column text lines (S7, W1, W2, P12, K3)
* ``month_sample_text``   wide rows -> month / November / December samples (P5-P7, K7)
* ``fanout_text``         26-column text rows -> three SHA-1 samples each (S12, F5, P8, K7)
* ``encode_text``         delimited rows + schema file -> encoded lines + id dictionary
                          (S10, S11, S12, F5, M10, P11, K5, K7)
* ``train_and_score``     users + labels -> split, fit, RMSE (P4, L1-L3, A13)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom import sinks
from featloom.operators import encode as enc
from featloom.operators import latest as lat
from featloom.operators import model as mdl
from featloom.operators import periods as per
from featloom.operators import samples as smp
from featloom.operators import snapshot as snp
from featloom.schemas import (CLICK_SCHEMA, DEFAULT_LATEST, DEFAULT_PERIODS, LOAN_SCHEMA, LOAN_SUM_SCHEMA,
                              ORDER_SCHEMA, USER_SCHEMA)
from featloom.sources import csv as csvsrc
from featloom.sources.parquet import load_table
from featloom.sources.specs import read_dictionary, read_feature_spec
from featloom.sources.text import parse_delimited, read_lines

TABLES = {"user": (csvsrc.read_users, USER_SCHEMA), "click": (csvsrc.read_clicks, CLICK_SCHEMA),
          "order": (csvsrc.read_orders, ORDER_SCHEMA), "loan": (csvsrc.read_loans, LOAN_SCHEMA),
          "loan_sum": (csvsrc.read_loan_sums, LOAN_SUM_SCHEMA)}


def convert_csv_tables(spark: SparkSession, csv_paths: dict, out_dir: str) -> dict:
    """CSV files (keys ``user click order loan loan_sum``) -> Parquet tables."""
    written = {}
    for name, path in csv_paths.items():
        reader, _schema = TABLES[name]
        target = f"{out_dir.rstrip('/')}/{name}"
        sinks.write_parquet(reader(spark, path), target)
        written[name] = target
    return written


def load_tables(spark: SparkSession, tables_dir: str) -> dict:
    return {name: load_table(spark, f"{tables_dir.rstrip('/')}/{name}", schema)
            for name, (_reader, schema) in TABLES.items()}


def build_wide(spark: SparkSession, tables_dir: str, out_path: str,
               periods: Sequence[int] = DEFAULT_PERIODS, period: str = "month") -> DataFrame:
    t = load_tables(spark, tables_dir)
    wide = per.wide_features(t["user"], t["click"], t["order"], t["loan"], t["loan_sum"], periods, period)
    sinks.write_parquet(wide, out_path)
    return spark.read.parquet(out_path)


def build_snapshots(spark: SparkSession, tables_dir: str, out_dir: str, months: Sequence[int] = (9, 10, 11),
                    run_id: int | str = 0) -> dict:
    """Snapshot users (sizes, sums, label) and the flat behaviour records, all
    partitioned by ``snapshot_month``."""
    t = load_tables(spark, tables_dir)
    out = {"users": snp.snapshot(t["user"], t["click"], t["order"], t["loan"], months, run_id),
           "clicks": snp.snapshot_records(t["click"], "click_time", months, run_id),
           "orders": snp.snapshot_records(t["order"], "buy_date", months, run_id),
           "loans": snp.snapshot_records(t["loan"], "loan_time", months, run_id)}
    paths = {}
    for name, df in out.items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        sinks.write_parquet(df, paths[name], partition_by="snapshot_month")
    return paths


def trailing_text(spark: SparkSession, wide_path: str, out_path: str, periods: Sequence[int] = DEFAULT_PERIODS,
                  order: Sequence[int] = DEFAULT_LATEST, num_files: int | None = None) -> None:
    """Wide rows -> one 90-column line per user, ordered by uid."""
    wide = spark.read.parquet(wide_path)
    full = lat.latest_map(lat.latest_numeric(wide, order=order), order=order)
    sinks.write_lines(full.select("uid", smp.trailing_line(full, periods, order).alias("line")), out_path,
                      order_by="uid", num_files=num_files)


def month_sample_text(spark: SparkSession, wide_path: str, out_dir: str,
                      periods: Sequence[int] = DEFAULT_PERIODS) -> dict:
    """Labelled month samples for every period but the last, an unlabelled one
    for the last, and the November/December variants (P6, P7)."""
    wide = spark.read.parquet(wide_path)
    periods = list(periods)
    specs = {f"month{p}": smp.month_sample(p, periods, label=(p != periods[-1])) for p in periods}
    specs["nov_step2"] = smp.month_sample(periods[1], periods, label="loanSum")
    specs["dec_step2"] = smp.month_sample(periods[2], periods, label=False)
    paths = {}
    for name, spec in specs.items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        sinks.write_lines(smp.sample_lines(wide, spec), paths[name])
    return paths


# The 26-column row read by the fan-out job, in order.
ROW26 = ("uid long, age int, sex int, active_date string, limit string, "
         "clickNum8 string, clickNum9 string, clickNum10 string, clickNum11 string, "
         "orderNum8 string, orderAmount8 string, orderNum9 string, orderAmount9 string, "
         "orderNum10 string, orderAmount10 string, orderNum11 string, orderAmount11 string, "
         "loanNum8 string, loanAmount8 string, loanNum9 string, loanAmount9 string, "
         "loanNum10 string, loanAmount10 string, loanNum11 string, loanAmount11 string, loanSum string")


def fanout_text(spark: SparkSession, rows_path: str, out_path: str) -> DataFrame:
    """26-column text rows -> three SHA-1 samples per row.  Rows with another
    field count are returned (not printed as empty lines, SURVEY D16)."""
    lines = read_lines(spark, rows_path)
    good, rejects = parse_delimited(lines, ROW26, keep=["line_order"])
    out = smp.fanout_samples(good, DEFAULT_PERIODS)
    sinks.write_lines(out, out_path)
    return rejects


def encode_text(spark: SparkSession, data_path: str, schema_path: str, out_dir: str,
                existing_idmap: str | None = None, sep: str = ",", existing_format: str = "text") -> dict:
    """The encoder job: rows + schema file (+ optional id dictionary) ->
    encoded lines (file order kept) and the grown dictionary."""
    spec = read_feature_spec(schema_path)
    lines = read_lines(spark, data_path)
    ddl = ", ".join(f"`{c}` string" for c in spec.columns)
    rows, rejects = parse_delimited(lines, ddl, keep=["line_order"], sep=sep)
    entries = enc.feature_entries(rows, spec, row_id="line_order")
    existing = None
    if existing_idmap:  # the key:id text form, or the lossless Parquet form
        existing = (load_table(spark, existing_idmap) if existing_format == "parquet"
                    else read_dictionary(spark, existing_idmap))
    dictionary = enc.build_dictionary(entries, row_id="line_order", existing=existing)
    encoded = enc.encode_lines(rows, spec, dictionary, row_id="line_order")
    paths = {"lines": f"{out_dir.rstrip('/')}/lines", "idmap": f"{out_dir.rstrip('/')}/idmap",
             "idmap_parquet": f"{out_dir.rstrip('/')}/idmap_parquet", "rejects": f"{out_dir.rstrip('/')}/rejects"}
    sinks.write_lines(encoded, paths["lines"], order_by="line_order")
    sinks.write_dictionary(dictionary, paths["idmap"], paths["idmap_parquet"])
    sinks.write_lines(rejects.select(F.col("value").alias("line")), paths["rejects"])
    return paths


def train_and_score(spark: SparkSession, tables_dir: str, label_month: int = 11) -> dict:
    """Users + their loan total of ``label_month`` -> hash split, linear fit,
    RMSE of the model and of the constant-zero baseline on validation."""
    t = load_tables(spark, tables_dir)
    labelled = snp.loan_label(t["user"], t["loan"], label_month, keep=t["user"].columns)
    data = mdl.hash_split(mdl.numeric_user_features(labelled).withColumn("label", F.col("loan_sum").cast("double")),
                          "uid")
    model = mdl.fit_linear(data.where("is_train"), mdl.USER_FEATURES, "label")
    scored = mdl.score(model, data.where("not is_train"), mdl.USER_FEATURES)
    r = mdl.rmse_many(scored, "label", {"zero": F.lit(0.0), "model": "prediction"}).first()
    return {"n_validation": r["n"], "rmse_zero": r["rmse_zero"], "rmse_model": r["rmse_model"],
            "coefficients": list(model.coefficients), "intercept": model.intercept}
