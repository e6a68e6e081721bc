"""Trailing "latest n periods" columns and keyed column merges.

The reference appends each trailing column by a self-join on row position.
On the wide row every input is already in the same row, so W1 and W2 are
plain projections: no shuffle at all.  Long-form inputs use a window per uid,
whose partitions hold one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.functions.mapstr import (entries_text_sql, entries_to_map_sql, ident, merge_maps, pack_entries,
                                      pack_map)
from featloom.schemas import DEFAULT_LATEST, TRAILING_MAPS, TRAILING_NUMERIC, latest_name


def latest_numeric(wide: DataFrame, metrics: Sequence[str] = TRAILING_NUMERIC,
                   order: Sequence[int] = DEFAULT_LATEST) -> DataFrame:
    """W1 (wide form): ``{metric}{order[n-1]}Latest{n}Month`` = sum of the n latest.

    Sums run in double, newest period first (O2).  Means are summed like any
    other metric, as the reference does.
    """
    out = []
    for m in metrics:
        acc = None
        for n, p in enumerate(order, start=1):
            v = F.col(f"{m}{p}").cast("double")
            acc = v if acc is None else acc + v
            out.append(acc.alias(latest_name(m, p, n)))
    return wide.select("*", *out)


def latest_numeric_long(long_df: DataFrame, value_cols: Sequence[str], key: str = "uid",
                        period: str = "period", order: Sequence[int] = DEFAULT_LATEST) -> DataFrame:
    """W1 (long form): running sums over a window per ``key``, newest first.

    Output: ``key, period, n, {value}_latest`` for the periods in ``order``.
    """
    order = list(order)
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(period))
    w = (Window.partitionBy(key).orderBy("_rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = long_df.where(F.col(period).isin(order)).withColumn("_rank", rank)
    return base.select(key, period, F.col("_rank").alias("n"),
                       *[F.sum(F.col(v).cast("double")).over(w).alias(f"{v}_latest") for v in value_cols])


def latest_map(wide: DataFrame, metrics: Sequence[str] = TRAILING_MAPS,
               order: Sequence[int] = DEFAULT_LATEST) -> DataFrame:
    """W2 (wide form): the same for packed maps.

    n=1 is the newest period's text verbatim; n>=2 is the key-wise sum of
    the parsed maps (doubles), packed sorted by key (SURVEY D10).  Malformed
    entries are dropped with the trailing-separator rule (D8).
    """
    order = list(order)
    base = wide.columns
    # Staged projections: each parsed map and running sum is one column that
    # later stages reference, so no map is parsed or merged twice per row.
    # Stage 1: split each packed text into entries once; stage 2: typed maps.
    staged = wide.select("*", *[F.expr(entries_text_sql(ident(f"{m}{p}"))).alias(f"_e_{m}_{p}")
                                for m in metrics for p in order])
    staged = staged.select(
        "*", *[F.expr(entries_to_map_sql(ident(f"_e_{m}_{p}"))).alias(f"_u_{m}_{p}") for m in metrics for p in order[1:]],
        *[F.expr(entries_to_map_sql(ident(f"_e_{m}_{order[0]}"))).alias(f"_a_{m}_1") for m in metrics])
    for n in range(2, len(order) + 1):
        p = order[n - 1]
        staged = staged.select("*", *[merge_maps(f"_a_{m}_{n - 1}", f"_u_{m}_{p}").alias(f"_a_{m}_{n}")
                                      for m in metrics])
    out = []
    for m in metrics:
        for n, p in enumerate(order, start=1):
            src = F.col(f"{m}{p}") if n == 1 else pack_map(f"_a_{m}_{n}")
            out.append(src.alias(latest_name(m, p, n)))
    return staged.select(*base, *out)


def latest_map_long(long_df: DataFrame, map_col: str, key: str = "uid", period: str = "period",
                    order: Sequence[int] = DEFAULT_LATEST) -> DataFrame:
    """W2 (long form): packed maps per ``(key, period)`` rows -> ``key, n, latest``.

    ``latest`` for ``n`` is the key-wise sum of the ``n`` newest periods'
    maps, packed sorted by map key; every ``n`` is typed (doubles), and an
    ``n`` is present when any of its periods has a row.  Entries are
    exploded and summed per ``(key, map key)`` with one conditional sum per
    ``n``, so the shuffle is map-side combined and no group is collected
    whole.
    """
    order = list(order)
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(period))
    # Parse in the row (last duplicate wins, malformed entries dropped), then
    # one row per (key, period, map key).  explode_outer keeps a period whose
    # map is empty as a placeholder (null map key), so the input is read once.
    ents = (long_df.where(F.col(period).isin(order))
            .select(key, rank.alias("_rank"), F.expr(entries_text_sql(ident(map_col))).alias("_e"))
            .select(key, "_rank", F.explode_outer(F.expr(entries_to_map_sql("_e"))).alias("_k", "_v")))
    n_max = len(order)
    by_rank = ents.groupBy(key, "_k").agg(
        F.min("_rank").alias("_first"),
        *[F.max(F.when(F.col("_rank") == r, F.col("_v"))).alias(f"_v{r}") for r in range(1, n_max + 1)])
    # Sums run newest first, in a fixed order, like the wide form.
    sums, acc = [], None
    for r in range(1, n_max + 1):
        v = F.coalesce(F.col(f"_v{r}"), F.lit(0.0))
        acc = v if acc is None else acc + v
        sums.append(F.struct(F.lit(r).alias("n"), F.when(F.col("_k").isNotNull(), acc).alias("_mv")))
    # One row per (key, map key, n) from the key's first period on; the
    # placeholder rows make every n with any period present appear.
    stacked = (by_rank.select(key, F.col("_k").alias("_mk"), "_first", F.inline(F.array(*sums)))
               .where(F.col("n") >= F.col("_first")))
    item = F.when(F.col("_mk").isNotNull(), F.struct(F.col("_mk").alias("key"), F.col("_mv").alias("value")))
    return stacked.groupBy(key, "n").agg(pack_entries(F.collect_list(item)).alias("latest"))


def latest_columns(metrics_numeric=TRAILING_NUMERIC, metrics_map=TRAILING_MAPS,
                   order: Sequence[int] = DEFAULT_LATEST) -> list[str]:
    """K6: names of the trailing columns in output order."""
    names = [latest_name(m, p, n) for m in metrics_numeric for n, p in enumerate(order, 1)]
    names += [latest_name(m, p, n) for m in metrics_map for n, p in enumerate(order, 1)]
    return names


def attach_column(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str],
                  order_by_key: bool = False) -> DataFrame:
    """J7 (+O1): attach columns of ``other`` by key, inner join.

    ``order_by_key`` sorts the result for ordered text output (a range
    shuffle); leave it off when order does not matter.
    """
    j = df.join(other.select(key, *cols), key, "inner")
    return j.orderBy(key) if order_by_key else j


def merge_map_columns(a: DataFrame, b: DataFrame, key: str, col_a: str, col_b: str,
                      out: str = "merged") -> DataFrame:
    """Inner join two keyed packed-map columns, merge by key with addition."""
    j = a.select(key, F.col(col_a).alias("_a")).join(b.select(key, F.col(col_b).alias("_b")), key, "inner")
    j = j.select(key, F.expr(entries_text_sql("_a")).alias("_ea"), F.expr(entries_text_sql("_b")).alias("_eb"))
    merged = merge_maps(F.expr(entries_to_map_sql("_ea")), F.expr(entries_to_map_sql("_eb")))
    return j.select(key, pack_map(merged).alias(out))


def combine_sum(a: DataFrame, b: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """A15 + U2: keyed sum of two tables; a key on one side keeps its value."""
    u = a.select(key, F.col(value).alias("_v")).unionByName(b.select(key, F.col(value).alias("_v")))
    return u.groupBy(key).agg(F.sum("_v").alias(out or value))
