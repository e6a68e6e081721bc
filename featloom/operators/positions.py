"""Dense row positions without a single-task sort (R5), and joins by position.

Rows are sorted by range partitions and numbered within each partition, in order, one
Arrow batch at a time.  What a partition has to add is a prefix sum over one small row
per partition.  A key that holds most of the rows is spread over many partitions like
any other run of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.session import cut_lineage


def _changes(b: pa.RecordBatch, keys: Sequence[str], last: list | None) -> np.ndarray:
    """True where a row's key differs from the row before (``last``: the key before the batch)."""
    out = np.zeros(b.num_rows, bool)
    for i, k in enumerate(keys):
        col = b.column(b.schema.get_field_index(k))
        out[0] |= last is not None and col[0].as_py() != last[i]
        a, z = col.slice(1), col.slice(0, len(col) - 1)
        same = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(z)), pc.equal(a, z), pc.and_(pc.is_null(a), pc.is_null(z)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
    return out


def _numbered(keys: Sequence[str], names: dict[str, str]):
    """Fills row number in the partition, number in the run of equal keys, and whether that run is the partition's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, start, first, last = 0, 0, True, None
        for b in batches:
            if not b.num_rows:
                continue
            idx = done + np.arange(b.num_rows)
            change = _changes(b, keys, last)
            starts = np.maximum.accumulate(np.where(change, idx, start))
            head = first & (np.cumsum(change) == 0)
            done, start, first = done + b.num_rows, int(starts[-1]), bool(head[-1])
            last = [b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in keys]
            cols = {names["idx"]: pa.array(idx), names["pos"]: pa.array(idx - starts), names["head"]: pa.array(head)}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], schema=b.schema)

    return run


def dense_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each key (the whole table without keys), in ascending ``order``, nulls first.

    Rows that are equal in all of ``order`` are numbered in any order.  Keys are atomic columns.
    """
    spark, keys, order = df.sparkSession, list(keys), list(order)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = {c.lower() for c in df.columns}
    names = {}
    for c in ("part", "idx", "head", "tie", "before"):
        names[c] = next(x for i in range(len(used) + 1) if (x := f"_{c}{i or ''}") not in used)
    names["pos"] = name
    if name.lower() in used:
        raise ValueError(f"the input already has a column {name}")
    # Equal rows are spread by their place in the input, so a repeated row cannot fill a partition.
    by = [*keys, *order, names["tie"]]
    rows = df.withColumn(names["tie"], F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop(names["tie"])
    rows = rows.withColumn(names["part"], F.spark_partition_id()).withColumns(
        {names["idx"]: F.lit(0).cast("long"), name: F.lit(0).cast("long"), names["head"]: F.lit(False)})
    rows = cut_lineage(rows.mapInArrow(_numbered(keys, names), rows.schema))  # both jobs below must see the same partitions
    key, idx = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1)), F.col(names["idx"])
    ends = rows.groupBy(names["part"]).agg(
        F.min_by(key, idx).alias("first"), F.max_by(key, idx).alias("last"), F.max_by(name, idx).alias("end"),
        F.max(F.when(F.col(names["head"]), idx)).alias("head_end"), F.max(idx).alias("all")).orderBy(names["part"]).collect()  # one row per partition
    offsets, last, held = [], None, 0
    for e in ends:
        before = held if last is not None and e["first"] == last else 0
        offsets.append((e[names["part"]], before))
        held = e["end"] + 1 + (before if e["head_end"] == e["all"] else 0)
        last = e["last"]
    table = spark.createDataFrame(offsets, f"`{names['part']}` int, `{names['before']}` long")
    out = rows.join(F.broadcast(table), names["part"])  # at most one row per range partition
    pos = F.col(name) + F.when(F.col(names["head"]), F.col(names["before"])).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], pos.alias(name))


def line_positions(lines: DataFrame, name: str = "pos") -> DataFrame:
    """R5 + S8: the 0-based position of each line over all files, in file order (``sources.text.read_lines``)."""
    return dense_positions(lines, [], ["line_order"], name)


def attach_by_position(left: DataFrame, right: DataFrame, columns: Sequence[str], order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Row i of ``left`` gets ``columns`` of row i of ``right``; surplus rows of either side go.

    Both sides are numbered apart; the join is an equi-join on the position, with ``pos`` in the result.
    """
    other = dense_positions(right, [], right_order).select("pos", *columns)
    return dense_positions(left, [], order).join(other, "pos")
