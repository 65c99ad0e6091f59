"""Decisions, intervals and display arithmetic.

Rounding follows the reference's Python ``round`` (half to even) with
``bround``; Spark's ``round`` is half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence(p) -> Column:
    """F8: ``max(p, 1 - p)``."""
    p = _c(p)
    return F.greatest(p, F.lit(1.0) - p)


def predicted_class(p) -> Column:
    """Class 1 when ``p > 0.5`` (ties go to 0, like argmax)."""
    return (_c(p) > F.lit(0.5)).cast("int")


def winner_text(p) -> Column:
    return F.when(_c(p) > F.lit(0.5), F.lit("Blue")).otherwise(F.lit("Red"))


def interval_fixed(x, half_width: float = 2.0, digits: int = 1):
    """(round(x, 1), round(max(0, x - 2), 1), round(x + 2, 1))."""
    x = _c(x)
    return (F.bround(x, digits), F.bround(F.greatest(F.lit(0.0), x - F.lit(half_width)), digits),
            F.bround(x + F.lit(half_width), digits))


def tower_range(x, half_width: float = 2.0, digits: int = 1):
    """low = max(0, round(x - 2, 1)) (round first), high = round(x + 2, 1)."""
    x = _c(x)
    return (F.greatest(F.lit(0.0), F.bround(x - F.lit(half_width), digits)),
            F.bround(x + F.lit(half_width), digits))


def parse_threshold(name) -> Column:
    """number inside a model name: ``over_20_5.joblib`` -> 20.5,
    ``time_over_28_min.joblib`` -> 28.0 (the ``.5`` is kept, quirk Q5 fixed)."""
    n = F.regexp_replace(_c(name), r"\.joblib$", "")
    m = F.regexp_extract(n, r"over_(\d+)(?:_(\d+))?", 0)
    whole = F.regexp_extract(n, r"over_(\d+)", 1)
    frac = F.regexp_extract(n, r"over_\d+_(\d+)", 1)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(
        F.when(frac == "", whole.cast("double")).otherwise(F.concat(whole, F.lit("."), frac).cast("double")))


def accuracy_tier(acc) -> Column:
    """> 70 high, < 50 low, else mid."""
    a = _c(acc)
    return F.when(a > 70, F.lit("high")).when(a < 50, F.lit("low")).otherwise(F.lit("mid"))
