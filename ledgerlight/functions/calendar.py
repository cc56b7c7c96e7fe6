"""Calendar columns of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def days_to_quarter_end(d: Column) -> Column:
    """Whole days from ``d`` to the last day of its quarter (never negative)."""
    q_end = F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))
    return F.greatest(F.datediff(q_end, d), F.lit(0))


def calendar_columns(date_col: str = "date") -> dict[str, Column]:
    """The reference's temporal feature block, in its column order.

    Holiday distance is not here: it needs the holiday table (see
    ``operators.calendar.add_holiday_distance``).
    """
    d = F.col(date_col)
    dow = F.weekday(d)  # Monday = 0
    is_month_end = (d == F.last_day(d))
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": is_month_end.cast("int"),
        "is_quarter_end": (is_month_end & (F.month(d) % 3 == 0)).cast("int"),
        "is_q4": (F.month(d) >= 10).cast("int"),
        "days_in_month": F.dayofmonth(F.last_day(d)),
        "days_to_quarter_end": days_to_quarter_end(d),
    }


def fourier_columns(date_col: str = "date") -> dict[str, Column]:
    """Weekly (period 7) and yearly (period 365) sine/cosine pairs."""
    d = F.col(date_col)
    dow = F.weekday(d).cast("double")
    doy = F.dayofyear(d).cast("double")
    return {
        "sin_week": F.sin(F.lit(TWO_PI) * dow / F.lit(7.0)),
        "cos_week": F.cos(F.lit(TWO_PI) * dow / F.lit(7.0)),
        "sin_year": F.sin(F.lit(TWO_PI) * doy / F.lit(365.0)),
        "cos_year": F.cos(F.lit(TWO_PI) * doy / F.lit(365.0)),
    }


def day_name(date_col: str = "date") -> Column:
    return F.date_format(F.col(date_col), "EEEE")


def year_month(date_col: str = "date") -> Column:
    return F.date_format(F.col(date_col), "yyyy-MM")
