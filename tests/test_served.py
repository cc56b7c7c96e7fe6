"""Property checks in the spirit of the reference's endpoint tests, run on
the driver's smallest tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlight.plans import registry as R
from ledgerlight.plans import served as S


@pytest.fixture(scope="module")
def bundle(spark):
    return R._bundle(spark, SF_SMALL)


@pytest.mark.parametrize("model,h", [("ensemble", 30), ("ensemble", 7), ("seasonal_naive", 14),
                                     ("moving_average", 14)])
def test_forecast_length_bounds_and_dates(spark, bundle, model, h):
    pts = S.forecast_points(bundle.forecasts, bundle.ensemble, model, h).toPandas()
    for _, g in pts.groupby("series_key"):
        assert len(g) == h
        d = sorted(g["date"])
        assert all((b - a).days == 1 for a, b in zip(d, d[1:]))
    assert (pts["yhat"] >= 0).all()
    banded = pts.dropna(subset=["yhat_lower", "yhat_upper"])
    assert (banded["yhat_lower"] <= banded["yhat"] + 1e-9).all()
    assert (banded["yhat"] <= banded["yhat_upper"] + 1e-9).all()


@pytest.mark.parametrize("model,h", [("ensemble", 91), ("ensemble", 0), ("unknown", 10)])
def test_bad_forecast_requests_rejected(bundle, model, h):
    with pytest.raises(ValueError):
        S.forecast_points(bundle.forecasts, bundle.ensemble, model, h)


def test_bad_granularity_and_range_rejected(spark):
    daily = R._daily(spark, SF_SMALL)
    with pytest.raises(ValueError):
        S.actuals(daily, "quarterly")
    with pytest.raises(ValueError):
        S.actuals(daily, "daily", dt.date(2001, 2, 1), dt.date(2001, 1, 1))


def test_actuals_monthly_has_fewer_points_and_positive(spark):
    daily = R._daily(spark, SF_SMALL)
    d = S.actuals(daily, "daily").toPandas()
    m = S.actuals(daily, "monthly").toPandas()
    assert len(m) <= len(d) and (d["value"] > 0).all()
    assert abs(d["total"].iloc[0] - m["total"].iloc[0]) < 0.05


def test_segment_shares_sum_to_100(spark):
    seg = R.QUERIES["segments"](spark, SF_SMALL).toPandas()
    assert abs(seg["share_pct"].sum() - 100) <= 0.1
    assert set(seg["segment"]) <= set(R.TEST_SEGMENTS)


def test_kpi_ranges(spark):
    k = R.QUERIES["kpis"](spark, SF_SMALL).first()
    assert k.total_revenue > 0 and k.n_transactions > 0 and k.n_customers > 0
    assert 0 <= k.recurring_share_pct <= 100 and 0 <= k.discount_rate_pct <= 100
    assert k.date_range_start <= k.date_range_end


def test_insight_types_valid(spark):
    rows = R.QUERIES["insights"](spark, SF_SMALL).collect()
    assert rows and {r.type for r in rows} <= {"trend", "risk", "opportunity", "info"}


def test_models_metrics_positive_and_winner_valid(spark):
    cmp = R.QUERIES["model_comparison"](spark, SF_SMALL).toPandas()
    assert (cmp["holdout_rmse"] > 0).all()
    for _, g in cmp.groupby("series_key"):
        assert g["is_winner"].sum() == 1
    w = cmp.dropna(subset=["weight"]).groupby("series_key")["weight"].sum()
    assert ((w - 1).abs() < 1e-3).all()


def test_no_leaky_features():
    from ledgerlight.operators.trees import FEATURE_COLS, LEAKY_COLS, check_no_leaks
    assert not set(FEATURE_COLS) & set(LEAKY_COLS)
    assert len(FEATURE_COLS) == len(set(FEATURE_COLS))
    with pytest.raises(ValueError):
        check_no_leaks(FEATURE_COLS + ["gp_margin"])


def test_empty_range_is_an_error_of_the_plan(spark):
    daily = R._daily(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("empty-range", "empty-range")
    late = S.actuals(daily, "weekly", dt.date(2090, 1, 1), dt.date(2090, 2, 1))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("empty-range")  # lazy
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for ask in (late.collect, late.count, lambda: late.write.format("noop").mode("overwrite").save()):
        with pytest.raises(Exception, match="no data in the date range"):
            ask()
    some = daily.limit(3)
    assert sorted(S.not_empty(some, "x").collect()) == sorted(some.collect())


@pytest.mark.parametrize("granularity", S.GRANULARITIES)
def test_fact_and_daily_ranges_agree(spark, granularity):
    start, end = dt.date(1996, 2, 10), dt.date(1996, 12, 3)
    fact = R._fact(spark, SF_SMALL)
    a = S.fact_actuals(fact, granularity, start, end)
    b = S.actuals(R._daily(spark, SF_SMALL), granularity, start, end)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.agg(F.min("date"), F.max("date")).first()[1] <= end


def test_segments_of_a_range(spark):
    fact = R._fact(spark, SF_SMALL)
    start, end = dt.date(1996, 2, 10), dt.date(1996, 12, 3)
    got = S.segments(fact, start, end)
    rows = got.collect()
    inside = fact.where(F.col("date").between(start, end)).toPandas()
    want = inside.groupby("segment").revenue.sum().round(2)
    assert {r.segment: r.revenue for r in rows} == pytest.approx(want.to_dict())
    assert all(r.total_revenue == pytest.approx(want.sum()) for r in rows)
    assert [r.revenue for r in rows] == sorted(want, reverse=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "1996-02-01" in pruned and "1996-12-01" in pruned
    assert S.segments(fact, dt.date(2090, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        S.segments(fact, end, start)


def test_report_of_a_range_and_its_scans(spark):
    from ledgerlight.operators import report as RP
    start, end = dt.date(1996, 2, 10), dt.date(1996, 12, 3)
    feats, fact = R._features(spark, SF_SMALL), R._fact(spark, SF_SMALL)
    out = RP.eda_report(fact, feats, ["lag_7d", "month", "is_weekend"], start, end)
    got = {(r.section, r.key, r.metric): r for r in out.collect()}
    f = fact.where(F.col("date").between(start, end)).toPandas()
    d = feats.where(F.col("date").between(start, end)).toPandas()
    v = lambda *k: got[k].value
    assert v("overview", "", "total_transactions") == len(f) and v("overview", "", "total_customers") == f.customer_id.nunique()
    assert v("overview", "", "total_products") == f.product_id.nunique()
    assert got["overview", "", "date_range"].text == f"{f.date.min()} to {f.date.max()}"
    assert v("overview", "", "median_daily_revenue") == pytest.approx(d.revenue.median(), abs=0.006)
    assert v("outliers", "", "days_above_p99") == (d.revenue > d.revenue.quantile(0.99)).sum()
    for seg, g in f.groupby("segment"):
        assert v("by_segment", seg, "total") == pytest.approx(g.revenue.sum()) and v("by_segment", seg, "count") == len(g)
    months = {k[1] for k in got if k[0] == "monthly_revenue"}
    assert months == {str(x)[:7] for x in f.date}
    assert {k[1] for k in got if k[0] == "top_correlated_features"} == {"lag_7d", "month", "is_weekend"}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 3  # sales, days, and the days' correlations


def test_report_without_rows(spark):
    from ledgerlight.operators import report as RP
    out = RP.eda_report(R._fact(spark, SF_SMALL), R._features(spark, SF_SMALL), ["lag_7d"], dt.date(2090, 1, 1))
    assert out.count() == 0


def _days(spark, revenue, discount=0.05, last=dt.date(2024, 9, 15), n=90):
    rows = []
    for i in range(n):
        day = last - dt.timedelta(days=n - 1 - i)
        rows.append(("total", day, float(revenue(i, day)), discount))
    return spark.createDataFrame(rows, "series_key string, date date, revenue double, avg_discount double")


def test_all_insights_with_their_details(spark):
    days = _days(spark, lambda i, d: (3000 if i < 60 else 1500) / (1 if d.weekday() < 5 else 2), discount=0.2)
    ens = spark.createDataFrame([(dt.date(2024, 9, 16), 2000.4), (dt.date(2024, 9, 17), 2000.4)], "date date, yhat_ensemble double")
    got = {r.metric: r for r in S.insights(days, ens).collect()}
    assert set(got) == {"revenue_30d_change_pct", "avg_discount_30d", "forecast_vs_actuals_pct", "weekday_weekend_ratio", None}
    p = days.toPandas().set_index("date").revenue
    last = dt.date(2024, 9, 15)
    back = p.index.map(lambda x: (last - x).days)
    recent, prior, tail = p[back <= 30].mean(), p[(back > 30) & (back <= 60)].mean(), p[-30:].mean()
    change = (recent - prior) / prior * 100
    trend = got["revenue_30d_change_pct"]
    assert trend.type == "risk" and trend.title == f"Revenue trending down {abs(change):.1f}%"
    assert trend.detail == (f"Average daily revenue over the last 30 days is ${recent:,.0f}, compared to "
                            f"${prior:,.0f} in the prior 30-day period.") and trend.value == pytest.approx(change, abs=0.006)
    uplift = (2000.4 - tail) / tail * 100
    fc = got["forecast_vs_actuals_pct"]
    assert fc.type == "opportunity" and fc.detail == (
        f"The ensemble model projects average daily revenue of $2,000 over the next 90 days, up {uplift:.1f}% "
        f"from the recent 30-day average of ${tail:,.0f}.")
    assert got["avg_discount_30d"].title == "High discount intensity: 20.0%" and got["weekday_weekend_ratio"].type == "info"
    assert "×" in got["weekday_weekend_ratio"].title and got[None].detail.startswith("Historical data")


def test_insights_of_little_data(spark):
    assert S.insights(_days(spark, lambda i, d: 5.0, n=1, last=dt.date(2024, 3, 1)), None).count() == 0
    assert S.insights(_days(spark, lambda i, d: 5.0).limit(0), None).count() == 0
    steady = S.insights(_days(spark, lambda i, d: 5.0, last=dt.date(2024, 3, 1)), None).collect()
    assert [r.type for r in steady] == ["risk"] and steady[0].title == "Revenue trending down 0.0%"


def test_null_profile_follows_the_table(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "new_column int, other double")
    from ledgerlight.operators.report import null_profile
    assert {r.column_name: r.null_count for r in null_profile(df).collect()} == {"new_column": 0, "other": 1}
