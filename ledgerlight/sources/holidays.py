"""Holiday calendars as tables.

Two calendars:

* ``uk_bank_holidays``: the reference's fixed list (2022-2024), kept as
  fixed values because the feature must match it where dates overlap.
* ``us_holidays``: built by rule for any span of years, derived from the data
  (the reference's US list repeats one month-day for every year; here moving
  holidays are computed from their weekday rule).

Both are tiny and bounded by the number of calendar years.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# UK bank holidays used by the reference's feature stage.
UK_BANK_HOLIDAYS = [
    "2022-01-03", "2022-04-15", "2022-04-18", "2022-05-02", "2022-05-30",
    "2022-06-02", "2022-06-03", "2022-08-29", "2022-12-26", "2022-12-27",
    "2023-01-02", "2023-04-07", "2023-04-10", "2023-05-01", "2023-05-08",
    "2023-05-29", "2023-08-28", "2023-12-25", "2023-12-26",
    "2024-01-01", "2024-03-29", "2024-04-01", "2024-05-06", "2024-05-27",
]

# US holiday names of the reference's additive model, with the
# rule used here to place them: (name, month, kind, weekday Mon=0, n / day).
US_HOLIDAY_RULES = [
    ("New Year", 1, "fixed", None, 1),
    ("MLK Day", 1, "nth", 0, 3),
    ("Presidents Day", 2, "nth", 0, 3),
    ("Memorial Day", 5, "last", 0, None),
    ("Independence Day", 7, "fixed", None, 4),
    ("Labor Day", 9, "nth", 0, 1),
    ("Thanksgiving", 11, "nth", 3, 4),
    ("Black Friday", 11, "thanksgiving+", None, 1),
    ("Cyber Monday", 11, "thanksgiving+", None, 4),
    ("Christmas", 12, "fixed", None, 25),
]


def uk_bank_holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("UK bank holiday", _dt.date.fromisoformat(d)) for d in UK_BANK_HOLIDAYS],
        "holiday string, ds date")


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    offset = (F.lit(weekday) - F.weekday(first) + 7) % 7
    return F.date_add(first, (offset + 7 * (n - 1)).cast("int"))


def last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, ((F.weekday(last) - F.lit(weekday) + 7) % 7).cast("int"))


def _rule_date(year: Column, month: int, kind: str, weekday, n) -> Column:
    if kind == "fixed":
        return F.make_date(year, F.lit(month), F.lit(n))
    if kind == "nth":
        return nth_weekday(year, month, weekday, n)
    if kind == "last":
        return last_weekday(year, month, weekday)
    return F.date_add(nth_weekday(year, 11, 3, 4), n)


def us_holidays(years: DataFrame, year_col: str = "year") -> DataFrame:
    """One row per (holiday, ds) for each year in ``years``."""
    y = F.col(year_col)
    rows = F.array(*[
        F.struct(F.lit(name).alias("holiday"), _rule_date(y, m, kind, wd, n).alias("ds"))
        for name, m, kind, wd, n in US_HOLIDAY_RULES
    ])
    return years.select(F.explode(rows).alias("_h")).select("_h.holiday", "_h.ds")


def years_spanned(df: DataFrame, date_col: str = "date", pad: int = 1) -> DataFrame:
    """Calendar years covered by ``df`` (plus ``pad`` on each side)."""
    bounds = df.agg(F.min(F.year(date_col)).alias("_y0"), F.max(F.year(date_col)).alias("_y1"))
    return bounds.select(F.explode(F.sequence(F.col("_y0") - pad, F.col("_y1") + pad)).alias("year"))


def holidays_for(df: DataFrame, calendar: str = "us", pad: int = 1) -> DataFrame:
    """The holidays of a calendar, "us" for the years of ``df`` or "uk" as listed."""
    if calendar == "us":
        return us_holidays(years_spanned(df, pad=pad))
    if calendar == "uk":
        return uk_bank_holidays(df.sparkSession)
    raise ValueError(f"no holiday calendar {calendar}")


def holiday_windows(holidays: DataFrame, lower: int = -1, upper: int = 1) -> DataFrame:
    """Prophet-style windows: one row per holiday and each day in
    ``[ds + lower, ds + upper]``."""
    return holidays.select(
        "holiday", "ds",
        F.explode(F.sequence(F.date_add("ds", lower), F.date_add("ds", upper))).alias("date"),
    )
