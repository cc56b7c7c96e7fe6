"""Forecast evaluation and simple forecasters (M2, M7-M9, M11-M13, M18, M19,
S8, W7-W10, O5, O6).

All operators take a daily frame keyed ``(series_key, date)`` and work on
every series at once.  Fold tables have a handful of rows per series; rows
are assigned to folds with an equi-join on ``series_key`` plus a range
condition on the row number, so a row meets at most ``n_folds`` fold rows
(no pairing of rows with rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.quantiles import exact_quantiles
from ledgerlight.operators.series import future_spine, latest_row, series_window


def index_rows(df: DataFrame) -> DataFrame:
    """Row number ``rn`` (1-based, by date) and row count ``n`` per series."""
    return df.withColumns({
        "rn": F.row_number().over(series_window()),
        "n": F.count(F.lit(1)).over(Window.partitionBy("series_key")),
    })


def series_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"),
                                        F.min("date").alias("first_date"),
                                        F.max("date").alias("last_date"))


def expanding_folds(df: DataFrame, n_splits: int = 5, test_size: int = 60,
                    holdout: int = 90) -> DataFrame:
    """M2: time-series split of the training part (all but the last
    ``holdout`` rows): fold i tests rows ``(end_i - test_size, end_i]`` and
    trains on every earlier row.  Rows are 1-based."""
    c = series_counts(df).withColumn("n_train", F.col("n") - holdout)
    folds = c.select("series_key", "n_train",
                     F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    end = F.col("n_train") - (n_splits - 1 - F.col("fold")) * test_size
    return (folds.select("series_key", "fold",
                         (end - test_size).alias("train_end"), end.alias("test_end"))
                 .where(F.col("train_end") >= 1))


def walk_forward_folds(df: DataFrame, initial: int = 600, step: int = 60, horizon: int = 90,
                       max_folds: int = 3) -> DataFrame:
    """M9: train on the first ``initial + i*step`` rows, test on the next
    ``horizon`` rows, for folds that end inside the series."""
    c = series_counts(df)
    folds = c.select("series_key", "n", F.explode(F.sequence(F.lit(0), F.lit(max_folds - 1))).alias("fold"))
    start = F.lit(initial) + F.col("fold") * step
    return (folds.select("series_key", "fold", start.alias("train_end"),
                         (start + horizon).alias("test_end"), "n")
                 .where(F.col("test_end") <= F.col("n")).drop("n"))


def origin_cutoffs(df: DataFrame, initial_days: int = 600, period_days: int = 60,
                   horizon_days: int = 90) -> DataFrame:
    """Calendar cutoffs stepping back by ``period_days`` from
    ``last - horizon_days`` while at least ``initial_days`` of history remain."""
    c = series_counts(df)
    span = F.datediff(F.date_sub("last_date", horizon_days), F.date_add("first_date", initial_days))
    k = F.floor(span / period_days)
    return (c.where(span >= 0)
             .select("series_key", F.explode(F.sequence(F.lit(0), k.cast("int"))).alias("fold"), "last_date")
             .select("series_key", "fold",
                     F.date_sub("last_date", (F.lit(horizon_days) + F.col("fold") * period_days).cast("int"))
                     .alias("cutoff")))


def assign_row_folds(indexed: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold with ``role`` train / test (needs ``rn``)."""
    j = indexed.join(folds, "series_key").where(F.col("rn") <= F.col("test_end"))
    return j.withColumn("role", F.when(F.col("rn") <= F.col("train_end"), "train").otherwise("test"))


def assign_day_folds(df: DataFrame, cutoffs: DataFrame, horizon_days: int = 90) -> DataFrame:
    j = df.join(cutoffs, "series_key").where(F.col("date") <= F.date_add("cutoff", horizon_days))
    return j.withColumn("role", F.when(F.col("date") <= F.col("cutoff"), "train").otherwise("test"))


def fold_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("series_key", "fold").agg(
        F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).cast("long").alias("train_rows"),
        F.sum(F.when(F.col("role") == "test", 1).otherwise(0)).cast("long").alias("test_rows"),
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train_end_date"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test_start_date"),
        F.max(F.when(F.col("role") == "test", F.col("date"))).alias("test_end_date"),
    )


def floor0(x) -> F.Column:
    """Predictions are never negative."""
    c = F.col(x) if isinstance(x, str) else x
    return F.greatest(c, F.lit(0.0))


METRICS = ("rmse", "mae", "mape")


def error_metrics(df: DataFrame, group_cols, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE, MAE and MAPE (denominator floored at 1), not rounded: weights,
    winners and means of folds are made of them."""
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*group_cols).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.greatest(F.col(y), F.lit(1.0))) * 100).alias("mape"),
        F.count(e).alias("n_eval"),
    )


def rounded_metrics(df: DataFrame, cols=METRICS) -> DataFrame:
    """Scores as they are shown, in cents."""
    return df.withColumns({c: rh(c, 2) for c in cols})


def cv_summary(fold_metrics: DataFrame, group_cols) -> DataFrame:
    """Mean and population std of the folds' scores, rounded once at the end."""
    return fold_metrics.groupBy(*group_cols).agg(
        rh(F.avg("rmse"), 2).alias("cv_rmse_mean"),
        rh(F.stddev_pop("rmse"), 2).alias("cv_rmse_std"),
        rh(F.avg("mae"), 2).alias("cv_mae_mean"),
        rh(F.stddev_pop("mae"), 2).alias("cv_mae_std"),
        rh(F.avg("mape"), 2).alias("cv_mape_mean"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def cv_or_holdout(cv: DataFrame, holdout_metrics: DataFrame) -> DataFrame:
    """``cv`` for every series of ``holdout_metrics``; a series too short for
    any fold shows its holdout scores as the means."""
    known = holdout_metrics.select("series_key", rh("rmse", 2).alias("_rmse"), rh("mae", 2).alias("_mae"))
    return known.join(cv, "series_key", "left").withColumns({
        "cv_rmse_mean": F.coalesce("cv_rmse_mean", "_rmse"), "cv_mae_mean": F.coalesce("cv_mae_mean", "_mae"),
        "n_folds": F.coalesce("n_folds", F.lit(0)),
    }).drop("_rmse", "_mae")


# ---------------------------------------------------------------- forecasters
def seasonal_naive_in_sample(df: DataFrame, season_col: str = "lag_7d") -> DataFrame:
    """In-sample prediction of the seasonal naive model: the value one
    season earlier (floored at 0)."""
    return df.select("series_key", "date", F.col("revenue").alias("y"),
                     floor0(season_col).alias("yhat"))


def moving_average_in_sample(df: DataFrame, col: str = "roll_mean_28d") -> DataFrame:
    return df.select("series_key", "date", F.col("revenue").alias("y"), floor0(col).alias("yhat"))


def seasonal_naive_future(df: DataFrame, horizon: int, season: int = 7) -> DataFrame:
    """Repeat the last ``season`` observed values: step h takes the value of
    row ``n - season + ((h - 1) mod season) + 1``."""
    idx = index_rows(df.select("series_key", "date", "revenue")).where(
        F.col("rn") > F.col("n") - season)
    last = series_counts(df).select("series_key", "last_date", "n")
    spine = future_spine(last, horizon).join(last.select("series_key", "n"), "series_key")
    spine = spine.withColumn("rn", F.col("n") - season + ((F.col("h") - 1) % season) + 1)
    return (spine.join(idx.select("series_key", "rn", "revenue"), ["series_key", "rn"])
                 .select("series_key", "date", "h", floor0("revenue").alias("yhat")))


def last_n_mean_future(df: DataFrame, horizon: int, window: int = 28) -> DataFrame:
    """Flat forecast at the mean of the last ``window`` values."""
    idx = index_rows(df.select("series_key", "date", "revenue")).where(
        F.col("rn") > F.col("n") - window)
    m = idx.groupBy("series_key").agg(
        F.try_divide(rh(F.sum("revenue"), 2), F.count("revenue")).alias("_m"),
        F.max("date").alias("last_date"))
    return future_spine(m, horizon).join(m.select("series_key", "_m"), "series_key").select(
        "series_key", "date", "h", floor0("_m").alias("yhat"))


def conformal_band(fc: DataFrame, holdout_errors: DataFrame, level: float = 0.9,
                   horizon: int | None = None) -> DataFrame:
    """M8 + W8: yhat -/+ q_level(|error|) x linspace(1, 1.5) over the horizon;
    lower bound floored at 0; bands rounded to cents, yhat untouched."""
    q = exact_quantiles(holdout_errors.withColumn("_ae", F.abs(F.col("y") - F.col("yhat"))),
                        "_ae", {"_alpha": level}, ["series_key"])
    hmax = F.max("h").over(Window.partitionBy("series_key")) if horizon is None else F.lit(horizon)
    scale = F.lit(1.0) + F.lit(0.5) * F.try_divide((F.col("h") - 1).cast("double"),
                                                   (hmax - 1).cast("double"))
    scale = F.coalesce(scale, F.lit(1.0))
    out = fc.join(q, "series_key", "left")
    return out.withColumns({
        "yhat_lower": rh(F.greatest(F.col("yhat") - F.col("_alpha") * scale, F.lit(0.0)), 2),
        "yhat_upper": rh(F.col("yhat") + F.col("_alpha") * scale, 2),
    }).drop("_alpha")


def future_regressors(hist: DataFrame, dates: DataFrame) -> DataFrame:
    """M19 + J11: assumed regressors for ``dates`` (is_q4 from the date,
    near_holiday 0, last-28-row mean revenue, last row's discount), replaced
    by the actual values wherever the history has the date."""
    last = latest_row(hist, ["avg_discount"])
    idx = index_rows(hist.select("series_key", "date", "revenue")).where(F.col("rn") > F.col("n") - 28)
    m28 = idx.groupBy("series_key").agg(
        F.try_divide(rh(F.sum("revenue"), 2), F.count("revenue")).alias("_m28"))
    assumed = (dates.join(last, "series_key", "left").join(m28, "series_key", "left")
               .select("series_key", "date",
                       (F.month("date") >= 10).cast("int").alias("_is_q4"),
                       F.lit(0).alias("_near_holiday"),
                       F.col("_m28").alias("_roll_mean_28d"),
                       F.col("last_avg_discount").alias("_avg_discount")))
    actual = hist.select("series_key", "date", "is_q4", "near_holiday", "roll_mean_28d", "avg_discount")
    j = assumed.join(actual, ["series_key", "date"], "left")
    return j.select("series_key", "date", *[
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c)
        for c in ("is_q4", "near_holiday", "roll_mean_28d", "avg_discount")])


def head_per_group(df: DataFrame, keys, n: int, order: str = "date") -> DataFrame:
    """First ``n`` rows per key (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
