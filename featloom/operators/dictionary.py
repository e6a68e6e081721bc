"""The id dictionary as a bucketed table grown by segments.

Each growth appends the keys it has not seen as one segment with the next range of ids;
nothing written before is touched or read again but for the lookup.  The table is
bucketed by key: finding new keys and encoding rows are joins in which only the rows are
shuffled, to the buckets of the table, and the dictionary is read where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.operators.encode import assign_ids


class SegmentedDictionary:
    """``table`` (in the session's catalog) holds ``key, id, segment``; its bucket count is fixed when it is made."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None) -> None:
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], "key string, id long, segment int")
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        # One task per bucket, so that a segment is one file per bucket.
        (rows.repartition(self.buckets, "key").write.mode("append").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.table))

    def load(self, existing: DataFrame) -> None:
        """Ids that are already given (``key, id``, one row per key) as the first segment."""
        self._append(existing.select("key", F.col("id").cast("long").alias("id"), F.lit(0).alias("segment")))

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """Rows of ``firsts`` (one per key) whose key has no id yet; only ``firsts`` is shuffled."""
        return firsts.join(self.read().select("key"), "key", "left_anti") if self.exists() else firsts

    def grow(self, entries: DataFrame, row_id: str = "row_id") -> int:
        """Gives new keys the next ids in first-seen order (``row_id, pos``, then key); returns how many there were."""
        firsts = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(F.col(row_id).alias("r"), F.col("pos").alias("p"))).alias("f"))
        new = self.unseen(firsts).select("key", F.col("f.r").alias("_r"), F.col("f.p").alias("_p"))
        top = self.read().agg(F.max("id").alias("id"), F.max("segment").alias("segment")).first()
        ids = assign_ids(new, ["_r", "_p", "key"], (top.id or 0) + 1).select("key", "id")
        n = ids.count()
        if n:
            self._append(ids.withColumn("segment", F.lit(0 if top.segment is None else top.segment + 1).cast("int")))
        return n

    def encode(self, entries: DataFrame) -> DataFrame:
        """``entries`` (any columns, ``key``) with ``id``, null for a key without one; only ``entries`` is shuffled."""
        return entries.join(self.read().select("key", "id"), "key", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
