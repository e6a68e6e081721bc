"""Packed maps in parts: maps of any width as sorted rows of bounded size.

A packed map ``k:v;k:v`` of one (user, period) grows with its distinct keys.  Here it is
cut, in key order, into parts of at most ``width`` entries: rows ``(..., part, packed)``.
The part of an entry is its dense position among the map's keys divided by ``width``, so
a user with millions of keys is many rows in many partitions, and the parts joined by
``;`` in order are the text of ``functions.mapstr.pack_map``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions.mapstr import map_entries_text, pack_entries_sql
from featloom.operators.positions import dense_positions

WIDTH = 10_000


def pack_parts(entries: DataFrame, by: Sequence[str], key: str = "key", value: str = "value", width: int = WIDTH) -> DataFrame:
    """``by``, ``part``, ``packed`` of entries whose keys are distinct within ``by``; a null key is an empty one."""
    rows = entries.select(*by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).alias("value"))
    placed = dense_positions(rows, by, ["key"]).withColumn("part", F.floor(F.col("pos") / width))
    return placed.groupBy(*by, "part").agg(F.expr(pack_entries_sql("collect_list(named_struct('key', key, 'value', value))")).alias("packed"))


def unpack_parts(parts: DataFrame, by: Sequence[str], value_type: str = "double") -> DataFrame:
    """Entries ``by``, ``key``, ``value`` of all parts: a narrow step; malformed entries go."""
    entries = map_entries_text(F.col("packed"), strip_trailing=True)
    return parts.select(*by, F.explode(entries).alias("e")).select(*by, F.col("e.key").alias("key"), F.col("e.value").cast(value_type).alias("value"))


def latest_parts(parts: DataFrame, key: str = "uid", order: Sequence[int] = (10, 9, 8), value_type: str = "double", width: int = WIDTH) -> DataFrame:
    """W2 over parts: for each n, the key-wise sum of the newest n periods, again in parts.

    Output: ``key, n, part, packed``; one map-side combined sum per (key, n, map key).  Unlike the
    wide form, n = 1 holds summed values too, not the source text.
    """
    newest = {p: i + 1 for i, p in enumerate(order)}
    age = F.create_map(*[F.lit(x) for p, i in newest.items() for x in (p, i)])
    entries = unpack_parts(parts.where(F.col("period").isin(list(order))), [key, "period"], value_type)
    # A period counts for every n from its own age on.
    grown = entries.withColumn("n", F.explode(F.sequence(age[F.col("period")], F.lit(len(newest)))))
    sums = grown.groupBy(key, "n", "key").agg(F.sum("value").alias("value"))
    return pack_parts(sums, [key, "n"], width=width)
