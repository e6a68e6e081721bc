"""Small arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_zero(x) -> Column:
    """``max(x, 0)`` keeping the input's numeric type."""
    return F.greatest(_c(x), F.lit(0))


def safe_ratio(num, den) -> Column:
    """Ratio that is ``null`` for a zero divisor instead of failing."""
    return F.try_divide(_c(num), _c(den))


def squared_error(pred, label) -> Column:
    d = _c(pred) - _c(label)
    return d * d


def empty_to(s, default) -> Column:
    """Empty or null text -> ``default`` literal, else the text."""
    c = _c(s)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)
