"""Training samples and text rows.

A sample is declared, not coded: ``Sample(label, [Discrete(..), Continuous(..)])``
compiles to one string column, so adding a sample needs no UDF.  Buckets of
constant slot names are computed on the driver; only per-row discrete values
are hashed in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.dates import year_month_text
from featloom.functions.hashing import (java_hash_bucket, java_hash_bucket_col, sha1_bucket,
                                        sha1_bucket_col)
from featloom.schemas import (DEFAULT_LATEST, DEFAULT_PERIODS, TRAILING_MAPS, TRAILING_NUMERIC,
                              WIDE_METRICS, period_columns)
from featloom.operators.latest import latest_columns


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_fields(sep: str, fields: Sequence) -> Column:
    """Fields joined by ``sep``; a null is an empty field, never a missing one."""
    return F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


@dataclass(frozen=True)
class Discrete:
    slot: str
    value: object  # column name or Column

    def render(self, hashing: str, buckets: int) -> Column:
        if hashing == "java":
            b = java_hash_bucket_col(_c(self.value), prefix=self.slot, n=buckets)
        else:
            b = sha1_bucket_col(_c(self.value), prefix=self.slot + "\t", n=buckets)
        return F.concat(b.cast("string"), F.lit(":1"))


@dataclass(frozen=True)
class Continuous:
    slot: str
    value: object
    as_double: bool = True  # the Java-hash format prints a double; the SHA-1 format the raw text

    def render(self, hashing: str, buckets: int) -> Column:
        b = java_hash_bucket(self.slot, buckets) if hashing == "java" else sha1_bucket(self.slot, buckets)
        v = _c(self.value).cast("double") if self.as_double else _c(self.value)
        return F.concat(F.lit(f"{b}:"), v.cast("string"))


@dataclass(frozen=True)
class Sample:
    """P10: ``label idx:val idx:val ...`` with features in declared order."""
    features: Sequence = field(default_factory=tuple)
    label: object = None  # Column / column name; None -> "0"
    hashing: str = "java"  # "java" (abs(String.hashCode) % n) or "sha1"
    buckets: int = 1000

    def line(self) -> Column:
        label = F.lit("0") if self.label is None else _c(self.label).cast("string")
        return concat_fields(" ", [label, *[f.render(self.hashing, self.buckets) for f in self.features]])


def month_sample(period: int, periods: Sequence[int] = DEFAULT_PERIODS, label=True,
                 slot_index: int | None = None) -> Sample:
    """P5: the month sample of ``period`` from a wide row.

    Discrete age, sex; continuous limit and five metrics of ``period`` with
    slot names ``{metric}_{i}`` (``i`` = 1-based position of the period).
    ``label=True`` uses the *next* period's loan amount; a column/name uses
    that column (P6); ``False`` leaves ``"0"`` (P7).
    """
    periods = list(periods)
    pos = periods.index(period)
    i = pos + 1 if slot_index is None else slot_index
    if label is True:
        if pos + 1 >= len(periods):
            raise ValueError(f"period {period} is the last one; a labelled sample needs the next period")
        label_col = F.col(f"loanAmount{periods[pos + 1]}").cast("double")
    elif label is False or label is None:
        label_col = None
    else:
        label_col = _c(label).cast("double")
    feats = [Discrete("age", "age"), Discrete("sex", "sex"), Continuous("limit", "limit")]
    feats += [Continuous(f"{m}_{i}", f"{m}{period}")
              for m in ("clickNum", "orderNum", "orderAmount", "loanNum", "loanAmount")]
    return Sample(feats, label_col)


def sample_lines(wide: DataFrame, sample: Sample, key: str = "uid") -> DataFrame:
    return wide.select(key, sample.line().alias("line"))


def fanout_samples(wide: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, key: str = "uid") -> DataFrame:
    """P8 + R3: one row -> one SHA-1 sample per period but the last.

    Label = the next period's loan amount; continuous slots are month-free
    (``click_num``, ``order_num``, ``order_sum``, ``loan_num``, ``loan_sum``)
    and values are printed as their text.  Output: ``key, period, line``.
    """
    periods = list(periods)
    txt = lambda c: F.col(c).cast("string")
    rows = F.array(*[
        F.struct(F.lit(p).alias("period"), txt(f"loanAmount{periods[k + 1]}").alias("label"),
                 txt(f"clickNum{p}").alias("click_num"), txt(f"orderNum{p}").alias("order_num"),
                 txt(f"orderAmount{p}").alias("order_sum"), txt(f"loanNum{p}").alias("loan_num"),
                 txt(f"loanAmount{p}").alias("loan_sum"))
        for k, p in enumerate(periods[:-1])])
    x = wide.select(key, "age", "sex", txt("limit").alias("limit"), F.inline(rows))
    feats = [Discrete("age", "age"), Discrete("sex", "sex"), Continuous("limit", "limit", as_double=False)]
    feats += [Continuous(s, s, as_double=False) for s in ("click_num", "order_num", "order_sum", "loan_num", "loan_sum")]
    s = Sample(feats, "label", hashing="sha1")
    return x.select(key, "period", s.line().alias("line"))


def raw_line(wide: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS, sep: str = ",") -> Column:
    """The wide row as one text line (``yyyy-M`` date, periods in order)."""
    parts = [F.col("uid"), F.col("age"), F.col("sex"), year_month_text("active_date"), F.col("limit")]
    for m in WIDE_METRICS:
        parts += [F.col(c) for c in period_columns(m, periods)]
    parts.append(F.col("loanSum"))
    return concat_fields(sep, parts)


def trailing_line(wide_with_latest: DataFrame, periods: Sequence[int] = DEFAULT_PERIODS,
                  order: Sequence[int] = DEFAULT_LATEST, sep: str = ",") -> Column:
    """P2 followed by the 24 numeric and 12 map trailing columns."""
    trailing = [F.col(c).cast("string") for c in latest_columns(TRAILING_NUMERIC, TRAILING_MAPS, order)]
    return concat_fields(sep, [raw_line(wide_with_latest, periods, sep), *trailing])
