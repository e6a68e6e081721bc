"""Per-period partial states, kept on disk and grown batch by batch (U1, K4, W1, W2 incrementally).

Each kind of behaviour has a table of partial aggregates at the finest grain (a user, a
period, a page and param or a category), partitioned by ``(period, batch)``.  Adding a
batch aggregates its rows only and replaces the partitions of that batch (dynamic
partition overwrite): nothing else is read or written, rows that arrive late go to
their own period under the later batch, and a batch that is added again after a failure
replaces itself instead of counting twice.  States add up, so features over any
periods are one aggregate over the partitions of those periods.

``compact`` merges the batches of a period into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.operators import periods as per
from featloom.schemas import DEFAULT_PERIODS
from featloom.session import delete_path

#: Per kind: the key of a state besides uid and period, and the sums it holds.
KEYS = {"clicks": ("pid", "param"), "orders": ("cate_id",), "loans": ()}
SUMS = {"clicks": ("n",), "orders": ("n", "amount", "discount"), "loans": ("n", "loan_amount", "q")}


class PeriodStore:
    """States under ``path``; ``period`` and ``per_plan_type`` as in ``periods.wide_features``."""

    def __init__(self, spark: SparkSession, path: str, periods: Sequence[int] = DEFAULT_PERIODS, period="month", per_plan_type: str | None = None) -> None:
        self.spark, self.path, self.periods, self.period, self.per_plan_type = spark, path.rstrip("/"), list(periods), period, per_plan_type

    def _states(self, kind: str, rows: DataFrame) -> DataFrame:
        if kind == "clicks":
            return per.click_period_counts(rows, self.periods, self.period)
        if kind == "orders":
            return per.order_period_stats(rows, self.periods, self.period)
        return per.loan_period_stats(rows, self.periods, self.period, per_plan_type=self.per_plan_type)

    def _write(self, kind: str, states: DataFrame) -> None:
        (states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy("period", "batch").parquet(f"{self.path}/{kind}"))

    def add(self, batch: str, **frames: DataFrame) -> None:
        """Adds a batch: any of ``clicks``, ``orders``, ``loans``.  The same name again replaces what it added before."""
        for kind, rows in frames.items():
            self._forget(kind, batch)
            self._write(kind, self._states(kind, rows).withColumn("batch", F.lit(batch)))

    def _folders(self, kind: str) -> list[tuple[str, str]]:
        """(period, batch) of the partitions there are: a listing of folders, not of rows."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/period=*/batch=*")
        found = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(jpath) or []
        names = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found]
        return [(p.split("=", 1)[1], b.split("=", 1)[1]) for p, b in names]

    def _forget(self, kind: str, batch: str) -> None:
        """Drops the batch's partitions, also of periods it no longer has rows in."""
        for p, b in self._folders(kind):
            if b == batch:
                delete_path(self.spark, f"{self.path}/{kind}/period={p}/batch={b}")

    def read(self, kind: str, like: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
        """States of the given periods, one row per key; ``like`` (states of this kind) gives the types of an empty store."""
        keys, sums = ["uid", "period", *KEYS[kind]], SUMS[kind]
        if not self._folders(kind):
            return like.select(*keys, *sums).limit(0)
        schema = like.withColumn("batch", F.lit("")).schema
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        rows = rows.where(F.col("period").isin(list(periods or self.periods)))
        # Sums keep their scale, so the text of a sum is that of one aggregate over all rows.
        return rows.groupBy(*keys).agg(*[F.sum(c).cast(like.schema[c].dataType).alias(c) for c in sums])

    def compact(self, kind: str, period: int, like: DataFrame, batch: str) -> None:
        """Merges all batches of a period into ``batch``: written first, then the others are dropped."""
        others = [b for p, b in self._folders(kind) if p == str(period) and b != batch]
        if not others:
            return
        merged = self.read(kind, like, [period]).withColumn("batch", F.lit(f"{batch}-merging"))
        self._write(kind, merged)
        for b in [*others, batch]:
            delete_path(self.spark, f"{self.path}/{kind}/period={period}/batch={b}")
        jvm, root = self.spark._jvm, f"{self.path}/{kind}/period={period}"
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{root}/batch={b}") for b in (f"{batch}-merging", batch))
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(old, new)

    def wide(self, users: DataFrame, like: dict[str, DataFrame], loan_sums: DataFrame | None = None) -> DataFrame:
        """A16 from the states: the wide row of every user; W1 and W2 are projections of it."""
        of = {kind: self.read(kind, self._states(kind, like[kind])) for kind in KEYS}
        p = self.periods
        return per.join_wide(users, per.click_wide(of["clicks"], p), per.order_wide(of["orders"], p), per.loan_wide(of["loans"], p), loan_sums, p)
