"""Calendar feature block (F7-F14, J13) on a frame with a ``date`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.calendar import calendar_columns, fourier_columns

HOLIDAY_CAP = 14
NEAR_HOLIDAY_DAYS = 3


def holiday_distance(holidays: DataFrame, cap: int = HOLIDAY_CAP) -> DataFrame:
    """J13 as an equi-join table: for every day within ``cap`` days of a
    holiday, the distance to the nearest one.  Days further away are absent
    and take ``cap``.  Size is bounded by 2 * cap + 1 rows per holiday."""
    return (holidays.select(F.posexplode(F.sequence(F.date_sub("ds", cap), F.date_add("ds", cap)))
                            .alias("_i", "date"))
                    .select("date", F.abs(F.col("_i") - cap).alias("_dist"))
                    .groupBy("date").agg(F.min("_dist").alias("days_to_holiday")))


def add_calendar_features(df: DataFrame, holidays: DataFrame, date_col: str = "date",
                          cap: int = HOLIDAY_CAP) -> DataFrame:
    """Temporal block of the daily features, in the reference's order:
    calendar fields, holiday distance and flag, then Fourier pairs."""
    out = df.withColumns(calendar_columns(date_col))
    dist = holiday_distance(holidays, cap).withColumnRenamed("date", date_col)
    out = out.join(dist, date_col, "left").withColumn(
        "days_to_holiday", F.coalesce(F.col("days_to_holiday"), F.lit(cap)).cast("int"))
    out = out.withColumn("near_holiday", (F.col("days_to_holiday") <= NEAR_HOLIDAY_DAYS).cast("int"))
    return out.withColumns(fourier_columns(date_col))
