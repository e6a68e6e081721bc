"""Sinks: Parquet tables, text lines, the id dictionary (K1, K3-K7).

Writes replace the target (``overwrite``), which is what the reference's
delete-then-write did.  Text output keeps Spark's natural partitioning unless
a file count is asked for; ``order_by`` range-sorts the lines first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """K1 / K4 (snapshot union partitioned by ``snapshot_month``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_lines(df: DataFrame, path: str, col: str = "line", order_by=None, num_files: int | None = None) -> None:
    """K3 / K7: one text line per row."""
    out = df
    if order_by:
        out = out.orderBy(order_by)
    out = out.select(F.col(col).cast("string").alias("value"))
    if num_files:
        out = out.coalesce(num_files)
    out.write.mode("overwrite").text(path)


def write_dictionary(dictionary: DataFrame, path: str, parquet_path: str | None = None) -> None:
    """K5: ``key:id`` lines; optionally also the Parquet form.

    A key that itself contains ``:`` cannot be read back from the text form
    (SURVEY D18); the Parquet form keeps every key and is the one to reload.
    """
    write_lines(dictionary.select(F.concat_ws(":", "key", F.col("id").cast("string")).alias("line")), path)
    if parquet_path:
        write_parquet(dictionary.select("key", F.col("id").cast("long")), parquet_path)


def trailing_schema(columns, existing: list[str] | None = None) -> list[str]:
    """K6: the output schema is the column list; trailing names are appended."""
    return list(existing or []) + [c for c in columns if c not in (existing or [])]


def write_column_names(spark, columns, path: str) -> None:
    """K6: the column list as a one-file text schema (one name per line, in order)."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, line string")
    write_lines(df, path, order_by="i", num_files=1)
