"""Served queries (Q1-Q4, Q8, Q9, A24-A28, F19, F20) as DataFrame functions.

The reference serves these from HTTP handlers over in-memory frames; here
each is a function of the daily / fact / forecast frames returning a
DataFrame.  Argument checks raise ``ValueError`` like the reference's
request validation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.fmt import money_short, money_whole
from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.daily import aggregate_daily
from ledgerlight.operators.forecast import METRICS
from ledgerlight.operators.quantiles import with_scalars
from ledgerlight.operators.report import fixed_mean, share_of_total
from ledgerlight.sources.io import between

GRANULARITIES = ("daily", "weekly", "monthly")
# Models whose stored forecasts ``forecast_points`` serves.
MODELS = ("ensemble", "boosted_trees", "decomposition_ridge", "seasonal_naive", "moving_average")


def check_horizon(h: int) -> int:
    if not 1 <= int(h) <= 90:
        raise ValueError("horizon must be between 1 and 90")
    return int(h)


def check_model(m: str) -> str:
    if m not in MODELS:
        raise ValueError(f"unknown model: {m}")
    return m


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error when it turns out to have no rows.

    The check is part of the plan: a count that gives one row in any case
    fails in a filter if it is zero, and is dropped there if it is not.  No
    job runs before the result is asked for."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    none = F.when(F.col("_n") == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    guard = n.where(none).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(guard)


def check_range(start: dt.date | None, end: dt.date | None) -> None:
    if start is not None and end is not None and end < start:
        raise ValueError("end_date must not be before start_date")


def actuals(daily: DataFrame, granularity: str = "daily", start: dt.date | None = None,
            end: dt.date | None = None, default_days: int = 180) -> DataFrame:
    """Revenue points in [start, end] (default: the last 180 days
    of data) at daily, weekly (Monday) or monthly grain, with total, mean and
    sample std of the points attached.  A range without data is an error."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    check_range(start, end)
    bounds = daily.agg(F.max("date").alias("_max"))
    lo = F.lit(start).cast("date") if start is not None else F.date_sub("_max", default_days)
    hi = F.lit(end).cast("date") if end is not None else F.col("_max")
    f = with_scalars(daily.select("date", "revenue"), bounds).where(F.col("date").between(lo, hi))
    f = not_empty(f, "no data in the date range")
    if granularity == "daily":
        pts = f.select("date", F.col("revenue").alias("value"))
    else:
        period = (F.date_trunc("week", "date") if granularity == "weekly"
                  else F.date_trunc("month", "date")).cast("date")
        pts = f.groupBy(period.alias("date")).agg(rh(F.sum("revenue"), 2).alias("value"))
    summary = pts.agg(rh(F.sum("value"), 2).alias("total"),
                      rh(fixed_mean("value", 2), 2).alias("mean"),
                      rh(F.stddev_samp("value"), 2).alias("std"))
    return with_scalars(pts, summary)


def kpis(daily: DataFrame, txn: DataFrame, ensemble: DataFrame | None) -> DataFrame:
    """Headline numbers from the daily series, the fact and the
    ensemble forecast (0 when there is none)."""
    d = daily.agg(
        rh(F.sum("revenue"), 2).alias("total_revenue"),
        rh(fixed_mean("revenue", 2), 2).alias("avg_daily_revenue"),
        rh(F.stddev_samp("revenue"), 2).alias("revenue_std"),
        rh(fixed_mean("gp_margin", 4) * 100, 2).alias("gp_margin_pct"),
        rh(fixed_mean("recurring_share", 4) * 100, 2).alias("recurring_share_pct"),
        rh(F.avg("avg_discount") * 100, 2).alias("discount_rate_pct"),
        F.min("date").alias("date_range_start"), F.max("date").alias("date_range_end"))
    t = txn.agg(F.countDistinct("customer_id").alias("n_customers"),
                F.countDistinct("product_id").alias("n_products"),
                F.count(F.lit(1)).alias("n_transactions"))
    out = with_scalars(d, t)
    if ensemble is not None:
        fc = ensemble.agg(rh(F.coalesce(F.sum("yhat_ensemble"), F.lit(0.0)), 2).alias("forecast_revenue_90d"))
        out = with_scalars(out, fc)
    else:
        out = out.withColumn("forecast_revenue_90d", F.lit(0.0))
    return out


def fact_actuals(txn: DataFrame, granularity: str = "daily", start: dt.date | None = None,
                 end: dt.date | None = None) -> DataFrame:
    """Q1 for a given range straight from the fact, of which only the months in the range are read."""
    check_range(start, end)
    return actuals(aggregate_daily(between(txn, start, end)), granularity, start, end)


def segments(txn: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Q3: revenue, count and share per segment from ``start`` to ``end`` (both
    included, none is open), the largest first (O2), with the revenue of all.
    A range without sales gives no rows."""
    check_range(start, end)
    shares = share_of_total(between(txn, start, end), "segment", total="total_revenue")
    return shares.orderBy(F.col("revenue").desc(), "segment")


def freshness(txn: DataFrame) -> DataFrame:
    """Q9: row count and last date."""
    return txn.agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("last_date"))


CV_COLUMNS = ("cv_rmse_mean", "cv_rmse_std", "cv_mae_mean", "cv_mae_std")


def comparison(weights: DataFrame, ensemble_metrics: DataFrame, winner: DataFrame, cv: DataFrame,
               top_features: DataFrame | None = None) -> DataFrame:
    """Q5: holdout scores of every model and the ensemble, cross-validation
    scores and weights of the models, whether a model wins its series, and the
    names of the features that a model relies on most.

    ``cv`` has series_key, model and ``CV_COLUMNS``; ``top_features`` has
    model and top_features, a few rows."""
    scores = [rh(m, 2).alias(f"holdout_{m}") for m in METRICS]
    singles = weights.select("series_key", "model", *scores, rh("weight", 4).alias("weight"))
    whole = ensemble_metrics.select("series_key", F.lit("ensemble").alias("model"), *scores,
                                    F.lit(None).cast("double").alias("weight"))
    out = (singles.unionByName(whole).join(cv.select("series_key", "model", *CV_COLUMNS), ["series_key", "model"], "left")
           .join(winner, "series_key"))
    if top_features is None:
        out = out.withColumn("top_features", F.lit(None).cast("string"))
    else:
        out = out.join(top_features, "model", "left")
    return out.select("series_key", "model", *[f"holdout_{m}" for m in METRICS], *CV_COLUMNS, "weight", "top_features",
                      (F.col("model") == F.col("winner")).alias("is_winner"))


# Titles and details of the insights, as the reference words them.
TREND_TITLE = "Revenue trending %s %.1f%%"
TREND_DETAIL = ("Average daily revenue over the last 30 days is %s, compared to %s in the prior 30-day period.")
DISCOUNT_TITLE = "High discount intensity: %.1f%%"
DISCOUNT_DETAIL = ("Average transaction discount over the last 30 days exceeds 15%. "
                   "Heavy discounting may be compressing gross profit margin.")
FORECAST_TITLE = "90-day forecast %s recent run-rate"
FORECAST_DETAIL = ("The ensemble model projects average daily revenue of %s over the next 90 days, "
                   "%s %.1f%% from the recent 30-day average of %s.")
WEEKDAY_TITLE = "Weekday revenue %.1f× higher than weekends"
WEEKDAY_DETAIL = "Average weekday revenue is %s vs %s on weekends. Campaign scheduling should prioritise weekdays."
Q4_TITLE = "Q4 seasonal uplift approaching"
Q4_DETAIL = ("Historical data shows consistent Q4 uplift (Oct–Dec). "
             "Consider increasing inventory and marketing spend ahead of the peak period.")


def _insight_numbers(daily: DataFrame, ensemble: DataFrame | None) -> DataFrame:
    """One row with all that the rules ask for: one aggregate over the days, one over the forecast."""
    s = daily.agg(F.array_sort(F.collect_list(F.struct("date", "revenue", "avg_discount"))).alias("days"))

    def mean(days, field: str = "revenue"):
        """Of the days that have the field; money is rounded to cents before it is divided."""
        values = F.filter(F.transform(days, lambda d: d[field]), lambda x: x.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.try_divide(rh(total, 2) if field == "revenue" else total, F.size(values))

    s = s.withColumn("last_date", F.try_element_at("days", F.lit(-1))["date"])
    back = lambda d: F.datediff(F.col("last_date"), d["date"])
    recent = F.filter("days", lambda d: back(d) <= 30)
    prior = F.filter("days", lambda d: (back(d) <= 60) & (back(d) > 30))
    s = s.select(
        "last_date", mean(recent).alias("recent_mean"), mean(prior).alias("prior_mean"),
        mean(recent, "avg_discount").alias("recent_disc"),
        mean(F.filter("days", lambda d: F.weekday(d["date"]) < 5)).alias("weekday_mean"),
        mean(F.filter("days", lambda d: F.weekday(d["date"]) >= 5)).alias("weekend_mean"),
        mean(F.slice("days", F.greatest(F.size("days") - 29, F.lit(1)), 30)).alias("actual_mean"))
    if ensemble is None:
        return s.withColumn("forecast_mean", F.lit(None).cast("double"))
    return with_scalars(s, ensemble.agg(
        F.try_divide(rh(F.sum("yhat_ensemble"), 2), F.count("yhat_ensemble")).alias("forecast_mean")))


def insights(daily: DataFrame, ensemble: DataFrame | None) -> DataFrame:
    """Q4: the five insight rules, one row per rule that fires."""
    s = _insight_numbers(daily, ensemble)
    c = F.col
    pct = F.try_divide(c("recent_mean") - c("prior_mean"), c("prior_mean")) * 100
    uplift = F.try_divide(c("forecast_mean") - c("actual_mean"), c("actual_mean")) * 100
    # without any weekend there is nothing to compare
    ratio = F.when(c("weekend_mean").isNotNull(), c("weekday_mean") / F.greatest(c("weekend_mean"), F.lit(1.0)))
    whole = lambda x: money_whole(F.coalesce(c(x), F.lit(0.0)))

    def rule(fires, kind, title, detail, metric=None, value=None):
        return F.when(fires, F.struct(
            kind.alias("type"), title.alias("title"), detail.alias("detail"),
            F.lit(metric).cast("string").alias("metric"),
            (F.lit(None).cast("double") if value is None else rh(value, 2)).alias("value")))

    rules = F.array(
        rule(c("recent_mean").isNotNull() & c("prior_mean").isNotNull(), F.when(pct > 0, "trend").otherwise("risk"),
             F.format_string(TREND_TITLE, F.when(pct > 0, "up").otherwise("down"), rh(F.abs(pct), 1)),
             F.format_string(TREND_DETAIL, whole("recent_mean"), whole("prior_mean")), "revenue_30d_change_pct", pct),
        rule(c("recent_disc") > 0.15, F.lit("risk"), F.format_string(DISCOUNT_TITLE, rh(c("recent_disc") * 100, 1)),
             F.lit(DISCOUNT_DETAIL), "avg_discount_30d", c("recent_disc") * 100),
        rule(c("forecast_mean").isNotNull(), F.when(uplift > 0, "opportunity").otherwise("risk"),
             F.format_string(FORECAST_TITLE, F.when(uplift > 0, "above").otherwise("below")),
             F.format_string(FORECAST_DETAIL, whole("forecast_mean"), F.when(uplift > 0, "up").otherwise("down"),
                             rh(F.abs(uplift), 1), whole("actual_mean")), "forecast_vs_actuals_pct", uplift),
        rule(ratio > 1.5, F.lit("info"), F.format_string(WEEKDAY_TITLE, rh(ratio, 1)),
             F.format_string(WEEKDAY_DETAIL, whole("weekday_mean"), whole("weekend_mean")), "weekday_weekend_ratio", ratio),
        rule(F.month("last_date").isin(8, 9), F.lit("opportunity"), F.lit(Q4_TITLE), F.lit(Q4_DETAIL)))
    return s.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))


def month_labels(monthly: DataFrame) -> DataFrame:
    """short money label and month label for monthly revenue rows."""
    first = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    return monthly.select("month", "revenue", money_short(F.col("revenue")).alias("revenue_label"),
                          F.date_format(first, "MMM yy").alias("month_label"))


def segment_exposure(txn: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Q8: the ensemble forecast total spread over segments by revenue share."""
    total = ensemble.agg(rh(F.sum("yhat_ensemble"), 2).alias("forecast_total"))
    shares = share_of_total(txn, "segment")
    return with_scalars(shares, total).select(
        "segment", "share_pct", "forecast_total",
        rh(F.col("forecast_total") * F.col("share_pct") / 100, 2).alias("projected"),
        money_short(rh(F.col("forecast_total") * F.col("share_pct") / 100, 2)).alias("projected_label"))


def forecast_points(forecasts: DataFrame, ensemble: DataFrame, model: str = "ensemble",
                    horizon: int = 90) -> DataFrame:
    """The first ``horizon`` days of one model's forecast per series.
    The ensemble band falls back to +-15 % of the forecast where missing."""
    check_model(model)
    horizon = check_horizon(horizon)
    from ledgerlight.operators.forecast import head_per_group
    if model == "ensemble":
        fc = ensemble.select(
            "series_key", "date", F.col("yhat_ensemble").alias("yhat"),
            rh(F.coalesce("ensemble_lower", F.col("yhat_ensemble") * 0.85), 2).alias("yhat_lower"),
            rh(F.coalesce("ensemble_upper", F.col("yhat_ensemble") * 1.15), 2).alias("yhat_upper"))
    else:
        fc = forecasts.where(F.col("model") == model).select(
            "series_key", "date", rh("yhat", 2).alias("yhat"), "yhat_lower", "yhat_upper")
    return head_per_group(fc, ["series_key"], horizon).withColumn("model", F.lit(model))
