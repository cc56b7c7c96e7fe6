"""Ridge correction on model residuals, per series.

The sums that a fit needs are one aggregate over all rows, and the small
systems of all series are solved in batches (``gram``): ridge with an
unpenalised intercept, as centred sums plus alpha on the diagonal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.forecast import floor0
from ledgerlight.operators.gram import gram_sums, solve

REGRESSORS = ["is_q4", "near_holiday", "roll_mean_28d", "avg_discount"]


def residual_sums(fitted: DataFrame, xs: Sequence[str] = REGRESSORS) -> DataFrame:
    """series_key, place, value: sums of the outer products of (1, xs, y - yhat)."""
    return gram_sums(fitted.withColumn("resid", F.col("y") - F.col("yhat")), ["series_key"], xs, "resid")


def named_sums(sums: DataFrame, xs: Sequence[str] = REGRESSORS) -> DataFrame:
    """The sums with the names of their two factors instead of their place."""
    names = ["one", *xs, "resid"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    factors = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    pair = F.get(factors, F.col("place"))
    return sums.select("series_key", pair["a"].alias("factor_a"), pair["b"].alias("factor_b"), "value")


def fit_residual_ridge(fitted: DataFrame, xs: Sequence[str] = REGRESSORS, alpha: float = 1.0) -> DataFrame:
    """``b0..`` and ``intercept`` per series; ``fitted`` has series_key, y, yhat and the regressors (J12 joined)."""
    coefs = solve(residual_sums(fitted, xs), ["series_key"], len(xs), alpha)
    return coefs.select("series_key", *[F.get("coef", F.lit(i)).alias(f"b{i}") for i in range(len(xs))], "intercept")


def apply_correction(fc: DataFrame, regs: DataFrame, coefs: DataFrame,
                     xs: Sequence[str] = REGRESSORS) -> DataFrame:
    """M7: yhat + intercept + x'b, floored at 0."""
    j = fc.join(regs, ["series_key", "date"], "left").join(coefs, "series_key", "left")
    lift = F.col("intercept")
    for i, c in enumerate(xs):
        lift = lift + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col(f"b{i}")
    return j.withColumn("yhat", floor0(F.col("yhat") + F.coalesce(lift, F.lit(0.0))))
