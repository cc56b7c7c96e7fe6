import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.calendar import calendar_columns, fourier_columns
from ledgerlight.functions.fmt import money_short
from ledgerlight.functions.ids import padded_id, pseudonym
from ledgerlight.functions.numeric import clip, round_half_up, safe_ratio


def test_pseudonym_matches_sha256(spark):
    ids = ["1", "42", "CG-12520"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string")
           .select(pseudonym("id")).collect()]
    want = ["CUST_" + hashlib.sha256(i.encode()).hexdigest()[:10].upper() for i in ids]
    assert got == want


def test_padded_id_keeps_wide_numbers(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "id long")
    assert [r[0] for r in df.select(padded_id("id")).collect()] == ["TXN_SS_000007", "TXN_SS_1234567"]


def test_round_half_up_and_clip_keep_nulls(spark):
    df = spark.createDataFrame([(0.125,), (2.5,), (None,), (-3.0,)], "x double")
    out = df.select(round_half_up("x", 2).alias("r"), clip("x", 0.0, 1.0).alias("c"),
                    safe_ratio(F.lit(1.0), "x").alias("q")).collect()
    assert [r.r for r in out] == [0.13, 2.5, None, -3.0]
    assert [r.c for r in out] == [0.125, 1.0, None, 0.0]
    assert out[2].q == 0.0


CALENDAR = {
    # date: weekday, ISO week, quarter, month end, quarter end, days in month, days to quarter end
    dt.date(2020, 12, 31): (3, 53, 4, 1, 1, 31, 0),
    dt.date(2021, 1, 3): (6, 53, 1, 0, 0, 31, 87),
    dt.date(2023, 10, 1): (6, 39, 4, 0, 0, 31, 91),
    dt.date(2023, 12, 30): (5, 52, 4, 0, 0, 31, 1),
    dt.date(2024, 2, 29): (3, 9, 1, 1, 0, 29, 31),
    dt.date(2024, 3, 31): (6, 13, 1, 1, 1, 31, 0),
    dt.date(2027, 1, 1): (4, 53, 1, 0, 0, 31, 89),
}


def test_calendar_columns_at_the_edges(spark):
    df = spark.createDataFrame([(d,) for d in CALENDAR], "date date").withColumns(calendar_columns())
    for r in df.collect():
        assert (r.day_of_week, r.week_of_year, r.quarter, r.is_month_end, r.is_quarter_end, r.days_in_month,
                r.days_to_quarter_end) == CALENDAR[r.date], r.date


def test_holiday_calendars(spark):
    from ledgerlight.operators.calendar import add_calendar_features
    from ledgerlight.sources.holidays import holidays_for
    days = [dt.date(2023, 5, 8), dt.date(2023, 5, 10), dt.date(2023, 5, 12), dt.date(2023, 7, 4)]
    df = spark.createDataFrame([("s", d) for d in days], "series_key string, date date")
    got = {c: {r.date: r.days_to_holiday for r in add_calendar_features(df, holidays_for(df, c)).collect()} for c in ("us", "uk")}
    assert [got["uk"][d] for d in days] == [0, 2, 4, 14]
    assert got["us"][days[3]] == 0 and got["us"][days[0]] == 14
    with pytest.raises(ValueError):
        holidays_for(df, "mars")


def test_fourier_columns(spark):
    import math
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date").withColumns(fourier_columns())
    r = df.first()
    assert abs(r.sin_week - 0.0) < 1e-12  # Monday
    assert abs(r.sin_year - math.sin(2 * math.pi / 365)) < 1e-12


def test_money_short(spark):
    df = spark.createDataFrame([(2_210_000.0,), (84_600.0,), (12.4,)], "v double")
    assert [r[0] for r in df.select(money_short(F.col("v"))).collect()] == ["$2.21M", "$84.6k", "$12"]
