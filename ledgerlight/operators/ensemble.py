"""Inverse-error ensemble.

Model metrics are a small frame ``(series_key, model, rmse, ...)``; weights,
the combined forecast, its holdout score and the winner are plain joins and
window sums over ``series_key`` on that frame, for any number of models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.forecast import error_metrics


def inverse_rmse_weights(metrics: DataFrame) -> DataFrame:
    """weight = (1 / rmse) / sum over the series' models of (1 / rmse)."""
    inv = F.lit(1.0) / F.col("rmse")
    return metrics.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy("series_key")))


def combine(forecasts: DataFrame, weights: DataFrame, band_model: str | None = None,
            lower_factor: float = 0.95, upper_factor: float = 1.05) -> DataFrame:
    """M15 + J9: weighted sum of the models' yhat per (series, date), kept
    only where every model has a value; the band is the ``band_model``'s
    widened by the factors, lower floored at 0.  ``forecasts`` is long:
    (series_key, model, date, yhat[, yhat_lower, yhat_upper])."""
    n_models = weights.groupBy("series_key").agg(F.count(F.lit(1)).alias("_m"))
    j = forecasts.join(weights.select("series_key", "model", "weight"), ["series_key", "model"])
    agg = [F.sum(F.col("weight") * F.col("yhat")).alias("_y"), F.count(F.lit(1)).alias("_k")]
    if band_model is not None:
        agg += [F.max(F.when(F.col("model") == band_model, F.col("yhat_lower"))).alias("_lo"),
                F.max(F.when(F.col("model") == band_model, F.col("yhat_upper"))).alias("_hi")]
    g = j.groupBy("series_key", "date").agg(*agg).join(n_models, "series_key")
    g = g.where(F.col("_k") == F.col("_m"))
    cols = [F.col("series_key"), F.col("date"), rh("_y", 2).alias("yhat_ensemble")]
    if band_model is not None:
        cols += [rh(F.greatest(F.col("_lo") * lower_factor, F.lit(0.0)), 2).alias("ensemble_lower"),
                 rh(F.col("_hi") * upper_factor, 2).alias("ensemble_upper")]
    return g.select(*cols)


def ensemble_holdout(holdouts: DataFrame, weights: DataFrame) -> DataFrame:
    """M16 + J10: weighted prediction on the dates every model scored (one
    inner alignment), then the error metrics."""
    n_models = weights.groupBy("series_key").agg(F.count(F.lit(1)).alias("_m"))
    j = holdouts.join(weights.select("series_key", "model", "weight"), ["series_key", "model"])
    g = (j.groupBy("series_key", "date")
          .agg(F.sum(F.col("weight") * F.col("yhat")).alias("yhat"), F.first("y").alias("y"),
               F.count(F.lit(1)).alias("_k"))
          .join(n_models, "series_key").where(F.col("_k") == F.col("_m")))
    return error_metrics(g, ["series_key"])


def winner(model_metrics: DataFrame, ens_metrics: DataFrame) -> DataFrame:
    """The ensemble wins only if its RMSE is strictly below every
    single model's; otherwise the single model with the lowest RMSE (ties
    to the first model name)."""
    best = model_metrics.groupBy("series_key").agg(
        F.min_by("model", F.struct("rmse", "model")).alias("_best"),
        F.min("rmse").alias("_best_rmse"))
    e = ens_metrics.select("series_key", F.col("rmse").alias("_ens_rmse"))
    return best.join(e, "series_key", "left").select(
        "series_key",
        F.when(F.col("_ens_rmse") < F.col("_best_rmse"), F.lit("ensemble"))
         .otherwise(F.col("_best")).alias("winner"))


def forecast_summary(fc: DataFrame, keys=("series_key", "model"), value: str = "yhat") -> DataFrame:
    """Days, mean, min, max of a forecast."""
    return fc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        rh(F.try_divide(rh(F.sum(value), 2), F.count(value)), 2).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))
