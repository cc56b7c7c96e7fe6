"""Additive regression with seasonality, holidays and regressors.

The reference's superseded path fits Prophet (multiplicative seasonality,
holiday windows, four standardised regressors).  Re-aimed here without a
changepoint solver: per series, a ridge regression of ``log1p(revenue)`` on

* a linear trend (years since the series' first date),
* weekly (3 pairs) and yearly (10 pairs) Fourier terms of the day number,
* one indicator per holiday for its +-1 day window,
* the four regressors,

all standardised with the training rows' mean and deviation.  Design columns
are built-in expressions, the fit is made of summed outer products (``gram``),
and predictions are expressions again, so the rows of a series never meet in
one task.  Prediction is ``expm1`` of the linear predictor, floored at 0, with
a band from the 90th percentile of absolute training residuals on the log
scale.  All three outputs are rounded to cents (trap 15: this path rounds yhat
too).

Rolling-origin scores need a fit at every cutoff.  The sums of the rows up to a
cutoff are those up to the one before it and those of the days between, so each
row is summed once, whatever the number of cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.forecast import error_metrics, origin_cutoffs
from ledgerlight.operators.gram import gram_sums, linear, running_sums, solve
from ledgerlight.operators.quantiles import exact_quantiles
from ledgerlight.operators.ridge import REGRESSORS
from ledgerlight.sources.holidays import US_HOLIDAY_RULES, holiday_windows

WEEKLY_ORDER = 3
YEARLY_ORDER = 10


def design_columns(holiday_names: Sequence[str] | None = None) -> list[str]:
    names = ["trend"]
    names += [f"{f}_w{k}" for k in range(1, WEEKLY_ORDER + 1) for f in ("sin", "cos")]
    names += [f"{f}_y{k}" for k in range(1, YEARLY_ORDER + 1) for f in ("sin", "cos")]
    names += [f"hol_{i}" for i, _ in enumerate(holiday_names or [n for n, *_ in US_HOLIDAY_RULES])]
    names += list(REGRESSORS)
    return names


def add_design(df: DataFrame, first: DataFrame, holidays: DataFrame) -> DataFrame:
    """Raw (unstandardised) design columns for rows with series_key, date
    and the regressors."""
    names = [n for n, *_ in US_HOLIDAY_RULES]
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("double")
    cols = {"trend": F.datediff(F.col("date"), F.col("_first")).cast("double") / 365.25}
    for k in range(1, WEEKLY_ORDER + 1):
        cols[f"sin_w{k}"] = F.sin(F.lit(2 * math.pi * k / 7.0) * day)
        cols[f"cos_w{k}"] = F.cos(F.lit(2 * math.pi * k / 7.0) * day)
    for k in range(1, YEARLY_ORDER + 1):
        cols[f"sin_y{k}"] = F.sin(F.lit(2 * math.pi * k / 365.25) * day)
        cols[f"cos_y{k}"] = F.cos(F.lit(2 * math.pi * k / 365.25) * day)
    win = (holiday_windows(holidays, -1, 1).groupBy("date")
           .agg(*[F.max((F.col("holiday") == n).cast("double")).alias(f"hol_{i}") for i, n in enumerate(names)]))
    out = df.join(first, "series_key").withColumns(cols).join(win, "date", "left")
    return out.fillna(0.0, subset=[f"hol_{i}" for i in range(len(names))]).drop("_first")


TARGET = "_y"


def _design(df: DataFrame, first: DataFrame, holidays: DataFrame, *keep: str) -> DataFrame:
    target = F.log1p(F.greatest(F.col("revenue"), F.lit(0.0))) if "revenue" in df.columns else F.lit(None).cast("double")
    return add_design(df, first, holidays).select(
        "series_key", "date", *keep, *design_columns(), target.alias(TARGET))


def first_dates(train: DataFrame) -> DataFrame:
    return train.groupBy("series_key").agg(F.min("date").alias("_first"))


def fit(train: DataFrame, holidays: DataFrame, alpha: float = 1.0) -> DataFrame:
    """series_key, n, coef, intercept of ``train`` (series_key, date, revenue, regressors)."""
    cols = design_columns()
    rows = _design(train, first_dates(train), holidays)
    return solve(gram_sums(rows, ["series_key"], cols, TARGET), ["series_key"], len(cols), alpha, standardise=True)


def _money(eta) -> F.Column:
    return rh(F.greatest(F.expm1(eta), F.lit(0.0)), 2)


def fit_predict(train: DataFrame, rows: DataFrame, holidays: DataFrame, alpha: float = 1.0,
                level: float = 0.9) -> DataFrame:
    """Fit on ``train`` (series_key, date, revenue, regressors) and predict
    ``rows`` (series_key, date, regressors), per series, with a band from the
    ``level`` quantile of the absolute residuals of the training rows."""
    cols, first = design_columns(), first_dates(train)
    coefs = fit(train, holidays, alpha)
    fitted = _design(train, first, holidays).join(coefs, "series_key")
    band = exact_quantiles(fitted.withColumn("_far", F.abs(F.col(TARGET) - linear(cols))), "_far",
                           {"_band": level}, ["series_key"])
    out = (_design(rows.drop("revenue"), first, holidays).join(coefs, "series_key").join(band, "series_key")
           .withColumn("_eta", linear(cols)))
    return out.select("series_key", "date", _money(F.col("_eta")).alias("yhat"),
                      _money(F.col("_eta") - F.col("_band")).alias("yhat_lower"),
                      _money(F.col("_eta") + F.col("_band")).alias("yhat_upper"))


def rolling_origin_scores(base: DataFrame, holidays: DataFrame, initial_days: int = 600, period_days: int = 60,
                          horizon_days: int = 90, alpha: float = 1.0) -> DataFrame:
    """RMSE, MAE and MAPE in the days after every cutoff of every series,
    each from a fit of the rows up to that cutoff (fold 0 is the last)."""
    cols = design_columns()
    cuts = origin_cutoffs(base, initial_days, period_days, horizon_days)
    ends = cuts.groupBy("series_key").agg(F.max("cutoff").alias("_last"), F.max("fold").alias("_folds"))
    rows = _design(base, first_dates(base), holidays, "revenue").join(ends, "series_key")
    back = F.datediff("_last", "date")  # days before the last cutoff

    # a row belongs to the earliest cutoff that it precedes, and so to all later ones
    parts = rows.where(back >= 0).withColumn(
        "fold", F.least(F.floor(back / period_days), F.col("_folds")).cast("int"))
    sums = gram_sums(parts, ["series_key", "fold"], cols, TARGET)
    each = running_sums(sums, cuts.select("series_key", "fold"), ["series_key"], "fold", len(cols))
    coefs = solve(each, ["series_key", "fold"], len(cols), alpha, standardise=True)

    # and it is tested after the cutoffs that lie less than a horizon before it
    low = F.greatest(F.floor(back / period_days) + 1, F.lit(0))
    high = F.least(F.floor((back + horizon_days) / period_days), F.col("_folds"))
    tested = rows.where(low <= high).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    scored = tested.join(coefs, ["series_key", "fold"]).select(
        "series_key", "fold", F.col("revenue").alias("y"), _money(linear(cols)).alias("yhat"))
    return error_metrics(scored, ["series_key", "fold"])
