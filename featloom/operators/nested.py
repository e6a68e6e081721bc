"""The user entity with its behaviour nested, in chunks of bounded size (A1, J1-J3, J6; F4 and A16 over it).

A user is one or more rows ``(uid, chunk_no)``, each with at most ``size`` clicks, orders and
loans in time order; a user with a third of all records is many rows.  The chunk of a
record is its dense position within (user, kind) divided by ``size``, so chunk numbers
do not depend on how the input is partitioned.  Each chunk carries the first and last
time of its records: plain columns that reach a Parquet scan as pushed filters.

The records are staged once.  Those of a user with at most ``heavy`` of them are numbered,
collected and joined to the user in one exchange by uid; only heavier users take the
range sort over many tasks.

Records of a kind are sorted by time, then by their other fields.  Nulls in a record are
kept; a record without a time comes first.  A user without records is one chunk (0) with
empty arrays; records of unknown users, or without a uid, are left out.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from featloom.operators import periods as per
from featloom.operators.positions import dense_positions
from featloom.schemas import DEFAULT_PERIODS, USER_COLUMNS
from featloom.session import scratch_path

#: Records of a user from which on they are sorted by many tasks.
HEAVY = 200_000
#: Records of one kind in a chunk.
SIZE = 1000
#: The array columns and the time column of their records.
KINDS = {"clicks": "click_time", "orders": "buy_date", "loans": "loan_time"}


def _instant(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _before(t: str, at: Column):
    return lambda r: _instant(r[t]) < at


def nest(users: DataFrame, clicks: DataFrame, orders: DataFrame, loans: DataFrame, loan_sums: DataFrame | None = None,
         size: int = SIZE, before_month: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """A1 + J1-J3 (+ F2 with ``before_month``, + J6 with ``loan_sums``): users with their records, chunk by chunk.

    Output: user columns, ``chunk_no``, ``clicks``, ``orders``, ``loans`` (arrays of records without uid),
    ``{kind}_from`` and ``{kind}_to`` (null for an empty array) and, given ``loan_sums``, ``loan_sum``
    (a plain left join: a uid that is repeated there repeats the user's chunks).
    """
    frames = {"clicks": clicks, "orders": orders, "loans": loans}
    rows = None
    for kind, df in frames.items():
        if before_month is not None:
            df = df.where(F.month(KINDS[kind]) < before_month)
        record = F.struct(*[F.col(c) for c in df.columns if c != "uid"])
        part = df.where("uid IS NOT NULL").select("uid", F.lit(kind).alias("kind"), _instant(F.col(KINDS[kind])).alias("t"), record.alias(kind))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = store(rows)  # read three times below
    uids, cols = users.select("uid").distinct(), [*USER_COLUMNS, "chunk_no", *KINDS, *[f"{k}_{e}" for k in KINDS for e in ("from", "to")]]
    scalars = users.select(*USER_COLUMNS)
    if loan_sums is not None:
        scalars = scalars.join(loan_sums.select("uid", "loan_sum"), "uid", "left").withColumn("loan_sum", F.coalesce("loan_sum", F.lit(0)))
        cols.append("loan_sum")
    many = rows.groupBy("uid").count().where(F.col("count") > heavy).select("uid")
    found = many.collect()  # at most one row per ``heavy`` records
    light, parts = rows, []
    if found:
        listed = F.broadcast(rows.sparkSession.createDataFrame(found, many.schema))
        light = rows.join(listed, "uid", "left_anti")
        # A user outside the user table is dropped here, before any record is sorted.
        spread = rows.join(listed, "uid", "left_semi").join(F.broadcast(uids.join(listed, "uid", "left_semi")), "uid", "left_semi")
        parts.append(dense_positions(spread, ["uid", "kind"], ["t", *KINDS]))
    # Partitioned by uid, the numbering, the chunks and the join need no other exchange.
    order = Window.partitionBy("uid", "kind").orderBy("t", *KINDS)
    parts.append(light.repartition("uid").withColumn("pos", F.row_number().over(order).cast("long") - 1))
    out = scalars.join(rows.select("uid").distinct(), "uid", "left_anti").withColumn("chunk_no", F.lit(0).cast("long"))
    out = out.withColumns({k: F.array().cast(ArrayType(rows.schema[k].dataType)) for k in KINDS})
    for placed in parts:
        # Chunks on the left: a user with many of them can be split by the skew join.
        out = _chunks(placed, size).join(scalars, "uid").unionByName(out, allowMissingColumns=True)
    return out.select(*cols)


def _chunks(placed: DataFrame, size: int) -> DataFrame:
    """``uid, chunk_no``, the arrays of records and their time spans."""
    of = {k: F.col("kind") == k for k in KINDS}
    return placed.withColumn("chunk_no", F.floor(F.col("pos") / size)).groupBy("uid", "chunk_no").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("pos", F.col(k).alias("r"))))), lambda e: e.r).alias(k) for k, on in of.items()],
        *[f(F.when(on, F.col("t"))).alias(f"{k}_{end}") for k, on in of.items() for end, f in (("from", F.min), ("to", F.max))])


def store(nested: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the nested table as Parquet (to the shared folder without a path) and reads it back."""
    path = path or scratch_path(nested.sparkSession, "nested-users")
    nested.write.mode("overwrite").parquet(path)
    return nested.sparkSession.read.schema(nested.schema).parquet(path)


def records(nested: DataFrame, kind: str, keep: Sequence[str] = ("uid",)) -> DataFrame:
    """The records of one kind as flat rows again: a narrow step that reads one array column."""
    return nested.select(*keep, F.inline(kind))


def cut_off(nested: DataFrame, cutoff: str | _dt.datetime) -> DataFrame:
    """only records strictly before a wall-clock ``cutoff``; dates count as their midnight, records without a time go.

    Whole chunks are judged by their time columns: one that ends before the cut-off passes unopened, one
    that begins at or after it is skipped by the scan (chunk 0 stays, for the user's own columns).
    """
    text = cutoff if isinstance(cutoff, str) else cutoff.strftime("%Y-%m-%d %H:%M:%S")
    at = F.lit(text).cast("timestamp_ntz")
    some = F.col("chunk_no") == 0
    for k in KINDS:
        some = some | (F.col(f"{k}_from") < at)
    out = nested.where(some)
    cols = {}
    for k, t in KINDS.items():
        none = F.array().cast(nested.schema[k].dataType)
        early = F.filter(k, _before(t, at))
        # The first record's time is null if any is, so only then a chunk that ends early is opened.
        whole = (F.col(f"{k}_to") < at) & (F.size(k) > 0) & F.get(F.col(k), F.lit(0))[t].isNotNull()
        cols[k] = F.when(whole, F.col(k)).when(F.col(f"{k}_from") < at, early).otherwise(none)
        cols[f"{k}_to"] = F.when(F.col(f"{k}_from") < at, F.when(whole, F.col(f"{k}_to")).otherwise(_instant(F.get(early, F.size(early) - 1)[t])))
        cols[f"{k}_from"] = F.when(F.col(f"{k}_from") < at, F.col(f"{k}_from"))
    return out.withColumns(cols)


def sizes(nested: DataFrame) -> DataFrame:
    """Records per user and kind: ``uid, n_clicks, n_orders, n_loans``."""
    return nested.groupBy("uid").agg(*[F.sum(F.size(k).cast("long")).alias(f"n_{k}") for k in KINDS])


def wide_features(nested: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, period="month", per_plan_type: str | None = None) -> DataFrame:
    """A16 over the nested entity: the wide row of every user.

    Each kind's array is unrolled inside its own task and combined there per (uid, period, sub-key), so
    what is shuffled are the partial sums of chunks, not records.  ``nested`` needs ``loan_sum`` for ``loanSum``.
    """
    first = nested.where("chunk_no = 0")
    loan_sums = first.select("uid", "loan_sum") if "loan_sum" in nested.columns else None
    flat = {k: records(nested, k) for k in KINDS}
    users = first.select(*USER_COLUMNS)
    return per.wide_features(users, flat["clicks"], flat["orders"], flat["loans"], loan_sums, periods, period, per_plan_type=per_plan_type)
