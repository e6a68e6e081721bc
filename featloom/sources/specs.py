"""Small driver-side spec files and the id dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.operators.encode import FeatureSpec
from featloom.sources.text import read_lines


def read_small_text(path: str, spark: SparkSession | None = None) -> list[str]:
    """Lines of a small spec file, in file order.

    Read through Spark's file-system layer (any Hadoop path: HDFS, object
    stores) when a session is active; a spec file is a few lines, so the
    lines are collected.  Without a session, the local file is read.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        with open(path, encoding="utf-8") as fh:
            return fh.read().splitlines()
    return [r.value for r in read_lines(spark, path).orderBy("line_order").select("value").collect()]


def read_column_names(path: str, spark: SparkSession | None = None) -> list[str]:
    """One column per line; the name is the first space-separated token."""
    return [ln.split(" ")[0].strip() for ln in read_small_text(path, spark) if ln.strip()]


def read_feature_spec(path: str, spark: SparkSession | None = None) -> FeatureSpec:
    """Names, exactly one ``label=``, any ``reserve=`` (spaces removed)."""
    return FeatureSpec.from_lines([ln for ln in read_small_text(path, spark) if ln.strip()])


def parse_dictionary(lines: DataFrame, order_col: str = "line_order") -> DataFrame:
    """``key:id`` lines (``value`` and an order column) -> ``key, id``.

    Spaces and tabs at both ends of a line are dropped.  Lines without exactly
    two parts are skipped; for a repeated key the last line in order wins
    (``max_by`` over the order column, no window over the whole file).
    """
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), ":", -1)
    ok = lines.where(F.size(parts) == 2).select(parts[0].alias("key"), parts[1].cast("long").alias("id"), order_col)
    return ok.groupBy("key").agg(F.max_by("id", order_col).alias("id"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S11 from a file, in file order."""
    return parse_dictionary(read_lines(spark, path))
