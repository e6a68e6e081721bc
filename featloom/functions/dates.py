"""Date and period helpers (M1, M3, M4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_of(ts, kind: str = "month") -> Column:
    """Period number of a date/timestamp.

    ``month``: month of year 1-12, ignoring the year (the reference's rule,
    SURVEY D1).  ``week``: ISO week of year.  ``year_month``: ``yyyy*100+M``
    for year-aware periods.
    """
    c = _c(ts)
    if kind == "month":
        return F.month(c)
    if kind == "week":
        return F.weekofyear(c)
    if kind == "year_month":
        return F.year(c) * 100 + F.month(c)
    raise ValueError(f"unknown period kind {kind!r}")


def year_month_text(d) -> Column:
    """M4: ``yyyy-M`` with an unpadded month, e.g. ``2016-1``."""
    return F.date_format(_c(d), "yyyy-M")


def ymd_text(d) -> Column:
    """``yyyy-M-d`` with unpadded month and day, from integer parts (no formatter)."""
    c = _c(d)
    return F.concat_ws("-", F.year(c).cast("string"), F.month(c).cast("string"), F.dayofmonth(c).cast("string"))


def parse_date(s, fmt: str = "yyyy-M-d") -> Column:
    """M1: strict date parse (ANSI: a bad value fails the job)."""
    return F.to_date(_c(s), fmt)


def parse_timestamp(s, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """M1: wall-clock timestamp (``timestamp_ntz``), no session-zone shift."""
    return F.to_timestamp_ntz(_c(s), F.lit(fmt))


def period_range(ts_col: str, kind: str, periods) -> Column | None:
    """A pushable range predicate covering ``periods``, when the kind allows one.

    Year-aware ``year_month`` periods (``yyyy*100+M``) map to
    ``first_day <= ts < day_after_last``, which reaches the Parquet scan as
    pushed filters and skips row groups.  Month-of-year and ISO-week periods
    ignore the year, so no range exists and ``None`` is returned.
    """
    import datetime as dt
    if kind != "year_month" or not periods:
        return None
    lo, hi = min(periods), max(periods)
    start = dt.date(lo // 100, lo % 100, 1)
    end = dt.date(hi // 100 + (hi % 100 == 12), hi % 100 % 12 + 1, 1)
    c = F.col(ts_col)
    return (c >= F.lit(start)) & (c < F.lit(end))
