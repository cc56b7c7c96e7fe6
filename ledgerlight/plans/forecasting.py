"""Forecasters and their ensemble, for every series at once.

A forecaster scores itself on the end of each series and forecasts beyond it;
``evaluate`` weighs any number of them by inverse holdout RMSE, combines
their forecasts, scores the ensemble and names the winner, as the reference
does with its two models.

``MODELS`` are the real ones: boosted trees, and a seasonal decomposition
whose residuals a ridge corrects, with a conformal band from the errors that
remain.  ``SIMPLE`` is a seasonal naive model and a moving average, whose
arithmetic SQL can follow value by value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators import ensemble as E
from ledgerlight.operators import forecast as FC
from ledgerlight.operators import ridge as RG
from ledgerlight.operators import trees as TR
from ledgerlight.operators.decompose import seasonal_forecast
from ledgerlight.operators.series import drop_warmup, future_spine, holdout_days, holdout_rows
from ledgerlight.sources.holidays import us_holidays, years_spanned

HORIZON = 90
HOLDOUT = 90


class Forecaster(Protocol):
    """A model of daily series.  ``base`` has series_key, date, revenue and the features."""

    name: str

    def holdout(self, base: DataFrame, n: int) -> DataFrame:
        """series_key, date, y, yhat over the last ``n`` rows or days, learnt from the rows before."""

    def future(self, base: DataFrame, horizon: int, scored: DataFrame) -> DataFrame:
        """series_key, date, h, yhat, yhat_lower, yhat_upper; ``scored`` is the holdout's result."""


def _no_band(fc: DataFrame) -> DataFrame:
    return fc.withColumns({c: F.lit(None).cast("double") for c in ("yhat_lower", "yhat_upper")})


class SeasonalNaive:
    name = "seasonal_naive"

    def holdout(self, base: DataFrame, n: int) -> DataFrame:
        return FC.seasonal_naive_in_sample(holdout_rows(base, n).where(F.col("split") == "holdout"))

    def future(self, base: DataFrame, horizon: int, scored: DataFrame) -> DataFrame:
        return _no_band(FC.seasonal_naive_future(base, horizon))


class MovingAverage:
    name = "moving_average"

    def holdout(self, base: DataFrame, n: int) -> DataFrame:
        return FC.moving_average_in_sample(holdout_days(base, n).where(F.col("split") == "holdout"))

    def future(self, base: DataFrame, horizon: int, scored: DataFrame) -> DataFrame:
        return FC.conformal_band(FC.last_n_mean_future(base, horizon), scored, 0.9, horizon)


class BoostedTrees:
    """M1-M4: one model over all series, forecast day by day on its own predictions."""

    name = "boosted_trees"

    def __init__(self, settings: TR.Boosting = TR.Boosting(), evaluated: Callable | None = None) -> None:
        """``evaluated`` (optional) gives (model, scored rows, metrics) of a fit that was made already."""
        self.settings, self.evaluated, self.model = settings, evaluated, None

    def holdout(self, base: DataFrame, n: int) -> DataFrame:
        made = self.evaluated() if self.evaluated else TR.holdout_eval(base, n, settings=self.settings)
        self.model, scored, _ = made
        return scored

    def future(self, base: DataFrame, horizon: int, scored: DataFrame) -> DataFrame:
        if self.model is None:
            self.holdout(base, HOLDOUT)
        holidays = us_holidays(years_spanned(base, pad=1))
        return _no_band(TR.recursive_forecast(base.sparkSession, self.model, base, holidays, horizon))


class CorrectedDecomposition:
    """M5-M8: decomposition of the rows before the holdout, a ridge on its own
    errors there, and a conformal band from the errors that the correction
    leaves; for the future the decomposition is refitted on all rows."""

    name = "decomposition_ridge"

    def _errors(self, base: DataFrame, n: int) -> DataFrame:
        split = holdout_days(base, n)
        fc = seasonal_forecast(split.where(F.col("split") == "train"), n)
        seen = split.where(F.col("split") == "holdout").select(
            "series_key", "date", F.col("revenue").alias("y"), *RG.REGRESSORS)
        return seen.join(fc.select("series_key", "date", "yhat"), ["series_key", "date"])

    def holdout(self, base: DataFrame, n: int) -> DataFrame:
        fitted = self._errors(base, n)
        regs = fitted.select("series_key", "date", *RG.REGRESSORS)
        return RG.apply_correction(fitted.select("series_key", "date", "y", "yhat"), regs,
                                   RG.fit_residual_ridge(fitted)).select("series_key", "date", "y", "yhat")

    def future(self, base: DataFrame, horizon: int, scored: DataFrame) -> DataFrame:
        coefs = RG.fit_residual_ridge(self._errors(base, HOLDOUT))
        dates = future_spine(FC.series_counts(base), horizon).select("series_key", "date")
        fc = RG.apply_correction(seasonal_forecast(base, horizon), FC.future_regressors(base, dates), coefs)
        return FC.conformal_band(fc.select("series_key", "date", "h", "yhat"), scored, 0.9, horizon)


SIMPLE = (SeasonalNaive, MovingAverage)
MODELS = (BoostedTrees, CorrectedDecomposition)


@dataclass
class Bundle:
    base: DataFrame
    holdouts: DataFrame
    metrics: DataFrame
    weights: DataFrame
    forecasts: DataFrame
    ensemble: DataFrame
    ensemble_metrics: DataFrame
    winner: DataFrame


def evaluate(features: DataFrame, horizon: int = HORIZON, holdout: int = HOLDOUT, materialize=None,
             models: Sequence[Forecaster] | None = None) -> Bundle:
    """All forecasters, their holdout scores, weights, the ensemble and the
    winner; the real models if none are given.  The ensemble's band is the last model's, widened by 5 %.
    ``materialize(name, build)`` (optional) writes an output once, so that the
    later steps and the served queries read it, as the reference's API reads
    the pipeline's forecast files; ``build`` is only called for the first."""
    m = materialize or (lambda name, build: build())
    models = models or [model() for model in MODELS]
    base = drop_warmup(features)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    columns = ["series_key", "model", "date", "h", "yhat", "yhat_lower", "yhat_upper"]
    holdouts = m("holdouts", lambda: union(
        [x.holdout(base, holdout).withColumn("model", F.lit(x.name)) for x in models]))
    weights = m("weights", lambda: E.inverse_rmse_weights(FC.error_metrics(holdouts, ["series_key", "model"])))
    metrics = weights.drop("weight")
    forecasts = m("forecasts", lambda: union(
        [x.future(base, horizon, holdouts.where(F.col("model") == x.name)).withColumn("model", F.lit(x.name))
         .select(columns) for x in models]))
    ens = m("ensemble", lambda: E.combine(forecasts, weights, band_model=models[-1].name))
    ens_metrics = m("ensemble_metrics", lambda: E.ensemble_holdout(holdouts, weights))
    return Bundle(base, holdouts, metrics, weights, forecasts, ens, ens_metrics, E.winner(metrics, ens_metrics))
