"""Null-safe numeric helpers.

ANSI mode is on, so every division goes through ``try_divide`` and every
clip keeps nulls as nulls (``least``/``greatest`` alone would replace a null
by the bound).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int = 2) -> Column:
    """Round half up as ``floor(x * 10^d + 0.5) / 10^d``.

    Written with plain IEEE arithmetic so that Spark and the DuckDB oracle
    produce the same bits; ``round`` in the two engines disagrees on values
    whose shortest decimal form ends in 5 at the cut.
    """
    scale = float(10 ** digits)
    return (F.floor(_c(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def safe_ratio(num, den, default: float | None = 0.0) -> Column:
    """``num / den`` with a zero or null denominator mapped to ``default``."""
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clip(x, lower: float | None = None, upper: float | None = None) -> Column:
    """pandas ``clip``: bounds applied, nulls kept."""
    col = _c(x)
    out = col
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(col.isNotNull(), out)


def sample_std_or_zero(x) -> Column:
    """Sample standard deviation, null (0 or 1 value) mapped to 0."""
    return F.coalesce(F.stddev_samp(_c(x)), F.lit(0.0))
