"""CSV scans of the five behaviour tables.

Header lines are skipped in every file (the reference only skipped the first
file's).  Fields are split on ``,`` with quoting off, dates are strict
``yyyy-M-d``, timestamps wall-clock ``yyyy-MM-dd HH:mm:ss``, and a malformed
value fails the read (``FAILFAST``).  So does an empty required field, when its
column is used; only an order's price has a default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.schemas import (CLICK_SCHEMA, LOAN_SCHEMA, LOAN_SUM_CSV_SCHEMA, ORDER_SCHEMA,
                              USER_SCHEMA)


def csv_options(date_format: str = "yyyy-M-d", ts_format: str = "yyyy-MM-dd HH:mm:ss") -> dict[str, str]:
    """The options of every CSV scan; ``from_csv`` over lines takes the same."""
    return {"mode": "FAILFAST", "quote": "\u0000", "nullValue": "", "dateFormat": date_format,
            "timestampNTZFormat": ts_format, "timestampFormat": ts_format}


def read_csv_table(spark: SparkSession, path: str, schema, header: bool = True,
                   date_format: str = "yyyy-M-d", ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return spark.read.schema(schema).option("header", header).options(**csv_options(date_format, ts_format)).csv(path)


def parse_csv_lines(lines: DataFrame, schema, value_col: str = "value") -> DataFrame:
    """Lines of one table -> its columns, under the options of the file scans."""
    return lines.select(F.from_csv(value_col, _ddl(schema), csv_options()).alias("r")).select("r.*")


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def required(df: DataFrame, *optional: str) -> DataFrame:
    """An empty field fails the job where it is read, except in ``optional`` and text columns."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name not in optional and f.dataType.simpleString() != "string":
            c = F.coalesce(c, F.raise_error(F.lit(f"required field {f.name} is empty")).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def as_users(df: DataFrame) -> DataFrame:
    """Every field of a user is required."""
    return required(df)


def as_clicks(df: DataFrame) -> DataFrame:
    """Every field of a click is required."""
    return required(df)


def as_orders(df: DataFrame) -> DataFrame:
    """S3: an empty price becomes -1 (then the amount clamps at 0, D11); the rest is required."""
    price = df.schema["price"].dataType
    return required(df.withColumn("price", F.coalesce(F.col("price"), F.lit(-1).cast(price))))


def as_loans(df: DataFrame) -> DataFrame:
    """Every field of a loan is required."""
    return required(df)


def as_loan_sums(df: DataFrame) -> DataFrame:
    """The second column (month) is read and dropped."""
    return required(df).select("uid", "loan_sum")


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return as_users(read_csv_table(spark, path, USER_SCHEMA))


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    return as_clicks(read_csv_table(spark, path, CLICK_SCHEMA))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return as_orders(read_csv_table(spark, path, ORDER_SCHEMA))


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    return as_loans(read_csv_table(spark, path, LOAN_SCHEMA))


def read_loan_sums(spark: SparkSession, path: str) -> DataFrame:
    return as_loan_sums(read_csv_table(spark, path, LOAN_SUM_CSV_SCHEMA))
