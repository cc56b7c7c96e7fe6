"""Classical seasonal decomposition forecast.

An approximation by design of the reference's multi-seasonal decomposition
with an ARIMA trend: for each period p (7, then 365):

1. trend = centred mean over p rows, kept only where the frame is full;
2. seasonal index = mean of (value - trend) per slot (days since epoch mod p,
   so gaps keep weekdays aligned), centred to sum to zero; subtracted;
3. a line (``regr_slope`` / ``regr_intercept`` on day offsets) through the
   last ``trend_rows`` deseasonalised values;
4. forecast = line + both indices at the future slot, floored at 0.

A period is used only when the series has at least two full cycles.
Sums of cents are rounded to cents before division (engine-independent).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.forecast import (assign_row_folds, error_metrics, floor0, index_rows, series_counts,
                                            walk_forward_folds)
from ledgerlight.operators.series import future_spine, series_window

EPOCH = "1970-01-01"


def decompose(df: DataFrame, periods: Sequence[int] = (7, 365)) -> tuple[DataFrame, list[DataFrame]]:
    """Deseasonalised values ``d`` and one index table per period."""
    cnt = series_counts(df).select("series_key", "n")
    cur = (df.select("series_key", "date", F.col("revenue").alias("d"))
             .withColumn("_pos", F.datediff(F.col("date"), F.lit(EPOCH).cast("date")))
             .join(cnt, "series_key"))
    indices = []
    for p in periods:
        half = (p - 1) // 2
        w = series_window().rowsBetween(-half, p - 1 - half)
        full = F.count("d").over(w) == p
        cur = cur.withColumn("_tr", F.when(full, F.try_divide(rh(F.sum("d").over(w), 2), F.count("d").over(w))))
        slot = F.col("_pos") % p
        raw = (cur.where(F.col("_tr").isNotNull() & (F.col("n") >= 2 * p))
                  .groupBy("series_key", slot.alias("_slot"))
                  .agg(F.try_divide(rh(F.sum(F.col("d") - F.col("_tr")), 2), F.count("d")).alias("_raw")))
        ix = raw.withColumn(f"s{p}", F.col("_raw") - F.avg("_raw").over(Window.partitionBy("series_key")))
        ix = ix.select("series_key", F.col("_slot").alias(f"slot{p}"), f"s{p}")
        indices.append(ix)
        cur = (cur.withColumn(f"slot{p}", slot).join(ix, ["series_key", f"slot{p}"], "left")
                  .withColumn("d", F.col("d") - F.coalesce(F.col(f"s{p}"), F.lit(0.0)))
                  .drop("_tr", f"s{p}", f"slot{p}"))
    return cur.drop("_pos", "n"), indices


def seasonal_forecast(df: DataFrame, horizon: int = 90, periods: Sequence[int] = (7, 365),
                      trend_rows: int = 90) -> DataFrame:
    deseason, indices = decompose(df, periods)
    last = series_counts(df)
    w = Window.partitionBy("series_key").orderBy(F.col("date").desc())
    tail = (deseason.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= trend_rows)
                    .join(last.select("series_key", "last_date"), "series_key")
                    .withColumn("_x", F.datediff("date", "last_date").cast("double")))
    line = tail.groupBy("series_key").agg(F.regr_slope("d", "_x").alias("_slope"),
                                          F.regr_intercept("d", "_x").alias("_icpt"))
    fc = future_spine(last, horizon).join(line, "series_key")
    pos = F.datediff(F.col("date"), F.lit(EPOCH).cast("date"))
    yhat = F.coalesce(F.col("_icpt"), F.lit(0.0)) + F.coalesce(F.col("_slope"), F.lit(0.0)) * F.col("h")
    for p, ix in zip(periods, indices):
        fc = fc.withColumn(f"slot{p}", pos % p).join(ix, ["series_key", f"slot{p}"], "left")
        yhat = yhat + F.coalesce(F.col(f"s{p}"), F.lit(0.0))
    return fc.select("series_key", "date", "h", rh(floor0(yhat), 2).alias("yhat"))


def walk_forward_scores(df: DataFrame, initial: int = 600, step: int = 60, horizon: int = 90, max_folds: int = 3,
                        **settings) -> DataFrame:
    """M9: RMSE, MAE and MAPE of the decomposition in every walk-forward fold of every series.

    A fold of a series is a series of its own: with (series, fold) as the key,
    one plan fits all of them, as many as there are.  Step h of a forecast is
    compared with the h-th row after the fold's training rows, whatever days
    are missing.
    """
    folds = walk_forward_folds(df, initial, step, horizon, max_folds)
    rows = assign_row_folds(index_rows(df.select("series_key", "date", "revenue")), folds)
    rows = rows.withColumn("series_key", F.struct("series_key", "fold"))
    fc = seasonal_forecast(rows.where(F.col("role") == "train").select("series_key", "date", "revenue"),
                           horizon, **settings)
    seen = rows.where(F.col("role") == "test").select(
        "series_key", (F.col("rn") - F.col("train_end")).cast("int").alias("h"), F.col("revenue").alias("y"))
    scored = seen.join(fc.select("series_key", "h", "yhat"), ["series_key", "h"])
    return error_metrics(scored, ["series_key"]).select("series_key.series_key", "series_key.fold", "rmse", "mae",
                                                        "mape", "n_eval")
