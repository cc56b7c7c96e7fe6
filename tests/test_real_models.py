"""The fitted models and what is served from them, on the smallest tables and on series of known shape."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlight.operators import ridge as RG
from ledgerlight.operators import trees as TR
from ledgerlight.operators.ingest import transaction_id
from ledgerlight.operators.series import add_rolling_and_lags, drop_warmup
from ledgerlight.plans import registry as R
from ledgerlight.plans.forecasting import MODELS, CorrectedDecomposition
from ledgerlight.sources.holidays import us_holidays


def _run(spark, name):
    return R.QUERIES[name](spark, SF_SMALL).toPandas()


def _features(spark, lengths):
    """Series of the given lengths with all model features."""
    from ledgerlight.operators.calendar import add_calendar_features
    start = dt.date(2021, 1, 1)
    rows = [(f"s{n}", start + dt.timedelta(days=i), 100.0 + 10 * math.sin(i / 7) + i % 7, 0.05)
            for n in lengths for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double, avg_discount double")
    hol = us_holidays(spark.createDataFrame([(y,) for y in (2020, 2021, 2022)], "year int"))
    return add_rolling_and_lags(add_calendar_features(df, hol)), hol


def test_recursive_forecast_of_short_series(spark):
    """Series shorter than the windows of the state neither fail nor lose a day."""
    lengths = [1, 20, 60, 89, 90, 91, 200]
    feats, hol = _features(spark, lengths)
    model = TR.fit(drop_warmup(feats.where("series_key = 's200'")), settings=TR.Boosting(rounds=3, patience=None))
    fc = TR.recursive_forecast(spark, model, feats, hol, 90).toPandas()
    for n in lengths:
        g = fc[fc.series_key == f"s{n}"].sort_values("h")
        first = dt.date(2021, 1, 1) + dt.timedelta(days=n)
        assert list(g.h) == list(range(1, 91))
        assert list(g.date) == [first + dt.timedelta(days=i) for i in range(90)]
        assert (g.yhat >= 0).all() and np.isfinite(g.yhat).all()


def _day_by_day(model, hist, disc, ewm, calendar, steps):
    """The recursion from its definition, one series, one day at a time, with the model's own prediction."""
    from pyspark.ml.linalg import Vectors
    out = []
    mean = lambda v: sum(v) / len(v)
    for cal in calendar[:steps]:
        f = dict(cal, avg_discount=mean(disc), ewm_14d=ewm)
        for w in (7, 14, 28, 90):
            v = hist[-w:]
            f[f"roll_mean_{w}d"] = mean(v)
            f[f"roll_std_{w}d"] = (sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)) ** 0.5 if len(v) > 1 else 0.0
        for k in (7, 14, 28, 56):
            f[f"lag_{k}d"] = hist[-k] if len(hist) >= k else mean(hist)
        f["momentum_7_28"] = f["roll_mean_7d"] / f["roll_mean_28d"] if f["roll_mean_28d"] > 0 else 1.0
        y = max(0.0, model.predict(Vectors.dense([float(f[c]) for c in TR.FEATURE_COLS])))
        out.append(y)
        hist, disc = (hist + [y])[-90:], (disc + [f["avg_discount"]])[-28:]
        ewm = ewm * 13 / 15 + y * 2 / 15
    return out


def test_recursion_follows_its_definition(spark):
    feats, hol = _features(spark, [3, 40, 95, 300])
    model = TR.fit(drop_warmup(feats), settings=TR.Boosting(rounds=12, patience=None))
    fc = TR.recursive_forecast(spark, model, feats, hol, 25).collect()
    state = TR._state(feats)
    rows = state.join(TR._calendar_plan(state, hol, 25), "series_key").collect()
    assert len(rows) == 4
    for r in rows:
        want = _day_by_day(model, list(r.hist), list(r.disc), r.ewm, [c.asDict() for c in r.cal], 25)
        got = [x.yhat for x in sorted((x for x in fc if x.series_key == r.series_key), key=lambda x: x.h)]
        np.testing.assert_allclose(got, want, atol=0.0051)


def test_forest_predicts_as_the_model(spark):
    feats, _ = _features(spark, [200, 260])
    rows = TR.with_vectors(feats)  # the first rows have empty lags
    model = TR.fit(drop_warmup(feats), settings=TR.Boosting(rounds=6, patience=None))
    got = model.transform(rows).select("features", "prediction").collect()
    x = np.array([r.features.toArray() for r in got])
    assert np.isnan(x).any()
    np.testing.assert_allclose(TR.forest(spark, model).predict(x), [r.prediction for r in got], rtol=1e-12)


def test_best_round():
    assert TR.best_round([5, 4, 3, 2, 1], 1) == 5
    assert TR.best_round([5, 4, 6, 7, 1], 2) == 2
    assert TR.best_round([5, 4, 6, 7, 1], 3) == 5
    assert TR.best_round([3, 3, 3], 1) == 1


def test_fit_stops_early_and_settings_reach_it(spark):
    """Noise can't be learnt, so more rounds only raise the error on the rows kept out."""
    rng = np.random.default_rng(3)
    cols = ["x", "z"]
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal(100, 10)), float(rng.normal()),
             float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double, x double, z double")
    settings = TR.Boosting(rounds=30, rate=0.5, patience=5, validation_rows=100)
    model = TR.fit(df, cols, settings)
    assert model.getNumTrees < 10
    assert TR.fit(df, cols, TR.Boosting(rounds=30, rate=0.5, patience=None)).getNumTrees == 30
    assert {round(w, 6) for w in model.treeWeights[1:]} <= {0.5}
    # a series with nothing but validation rows is fitted with all rounds
    assert TR.fit(df.limit(50), cols, TR.Boosting(rounds=4, patience=5, validation_rows=100)).getNumTrees == 4


def test_guard_rejects_same_day_columns_of_any_name():
    for c in ("rev_newseg", "rev_per_customer", "n_customers", "gp_margin"):
        with pytest.raises(ValueError):
            TR.check_no_leaks(TR.FEATURE_COLS + [c])
    TR.check_no_leaks(TR.FEATURE_COLS)


def test_new_breakdown_values_stay(spark):
    from ledgerlight.operators.daily import aggregate_daily
    fact = R._fact(spark, SF_SMALL).withColumn("segment", F.lit("NewSeg"))
    daily = aggregate_daily(fact, None, False, {"segment": ["NewSeg"]})
    assert "rev_newseg" in R._numeric(daily)
    sums = daily.agg(F.sum("rev_newseg"), F.sum("revenue")).first()
    assert sums[0] == pytest.approx(sums[1])


def test_plain_path_loses_no_line(spark):
    """Deduplication removes copies only; the plain tables have none."""
    txn = R.star(spark, SF_SMALL)[2]
    audit = R.clean_star(spark, SF_SMALL)[2]
    removed = txn.where("revenue <= 0").count()
    assert txn.select("transaction_id").distinct().count() == txn.count()
    assert audit.count() == txn.count() - removed
    dirty = _run(spark, "clean_audit").iloc[0]
    assert dirty.removed_duplicates == txn.where("order_key % 71 = 0").count() > 0


def test_id_tells_lines_apart(spark):
    rows = [(1, 1, 2, 3, 5, 10.0), (1, 1, 2, 4, 5, 10.0), (1, 1, 2, 3, 6, 10.0), (1, 1, 2, 3, 5, 10.01), (1, 1, 2, 3, 5, 10.0)]
    df = spark.createDataFrame(rows, "order_key int, line_number int, part_key int, supp_key int, quantity int, sales double")
    assert df.select(transaction_id()).distinct().count() == 4


def test_tree_queries(spark):
    hold, imp, fc = (_run(spark, q) for q in ("tree_holdout", "tree_importance", "tree_forecast"))
    assert len(hold) == 5 and (hold.n_eval == 90).all() and (hold.rmse >= hold.mae).all()
    assert imp.importance.sum() <= 1 + 1e-6 and imp.relative.iloc[0] == 1 and imp.importance.is_monotonic_decreasing
    assert set(imp.feature) <= set(TR.FEATURE_COLS)
    for _, g in fc.groupby("series_key"):
        g = g.sort_values("h")
        assert len(g) == 90 and all((b - a).days == 1 for a, b in zip(g.date, g.date[1:]))
    assert (fc.yhat >= 0).all()


def test_tree_cv(spark):
    cv = _run(spark, "tree_cv")
    assert len(cv) == 5 and (cv.n_folds >= 1).all() and (cv.cv_rmse_mean > 0).all() and (cv.cv_rmse_std >= 0).all()


def test_ridge_against_closed_form(spark):
    base = R._base(spark, SF_SMALL).select("series_key", "date", "revenue", *RG.REGRESSORS)
    fitted = base.selectExpr("*", "revenue as y", "roll_mean_28d as yhat")
    got = {r.series_key: r for r in RG.fit_residual_ridge(fitted).collect()}
    pdf = fitted.toPandas()
    for key, g in pdf.groupby("series_key"):
        x = g[RG.REGRESSORS].to_numpy(dtype=float)
        y = (g.y - g.yhat).to_numpy(dtype=float)
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
        assert np.allclose([got[key][f"b{i}"] for i in range(4)], beta, rtol=1e-4, atol=1e-3)
    lift = _run(spark, "ridge_lift")
    assert (lift.yhat >= 0).all() and (lift.groupby("series_key").size() == 90).all()


def test_additive_queries(spark):
    hold, fc = _run(spark, "additive_holdout"), _run(spark, "additive_forecast")
    assert len(hold) == 5 and (hold.rmse >= hold.mae).all() and (hold.n_eval > 0).all()
    assert (fc.groupby("series_key").size() == 90).all() and (fc.yhat >= 0).all()


def test_real_ensemble(spark):
    table = _run(spark, "real_model_comparison")
    names = {m.name for m in MODELS}
    for _, g in table.groupby("series_key"):
        single = g[g.model != "ensemble"]
        assert set(g.model) == names | {"ensemble"} and g.is_winner.sum() == 1
        assert single.weight.sum() == pytest.approx(1, abs=1e-3)
        inverse = 1 / single.holdout_rmse
        assert np.allclose(single.weight, inverse / inverse.sum(), atol=1e-3)
        assert (single.cv_rmse_mean > 0).all() and (single.cv_mae_mean <= single.cv_rmse_mean).all()
        short = single[single.model == "decomposition_ridge"].iloc[0]  # these series are too short for a fold
        assert short.cv_rmse_mean == short.holdout_rmse and np.isnan(short.cv_rmse_std)
        assert g[g.model == "ensemble"].cv_rmse_mean.isna().all()
        trees = g[g.model == "boosted_trees"].iloc[0]
        assert set(trees.top_features.split(",")) <= set(TR.FEATURE_COLS) and len(trees.top_features.split(",")) == 10
        assert g[g.model != "boosted_trees"].top_features.isna().all()
    fc = _run(spark, "real_forecast")
    assert (fc.groupby(["series_key", "model"]).size() == 90).all() and (fc.yhat >= 0).all()
    banded = fc.dropna(subset=["yhat_lower"])
    assert (banded.yhat_lower <= banded.yhat_upper).all()
    b = R._real_bundle(spark, SF_SMALL)
    w = {(r.series_key, r.model): r.weight for r in b.weights.collect()}
    one = fc.pivot_table(index=["series_key", "date"], columns="model", values="yhat")
    for (key, _), r in one.iterrows():
        assert r["ensemble"] == pytest.approx(sum(w[key, m] * r[m] for m in names), abs=0.02)


def test_served_from_the_real_ensemble(spark):
    total = _run(spark, "real_forecast")
    want = total[total.model == "ensemble"].yhat.sum()
    assert _run(spark, "real_kpis").forecast_revenue_90d[0] == pytest.approx(want, abs=1)
    exposure = _run(spark, "real_segment_exposure")
    assert exposure.projected.sum() == pytest.approx(want, rel=1e-3)
    assert set(_run(spark, "real_insights").type) <= {"trend", "risk", "opportunity", "info"}


def test_correction_lowers_the_holdout_error(spark):
    """The ridge is fitted on the decomposition's own errors, so squared error there can't grow."""
    base = R._base(spark, SF_SMALL)
    model = CorrectedDecomposition()
    before = model._errors(base, 90).selectExpr("series_key", "y", "yhat").toPandas()
    after = model.holdout(base, 90).toPandas()
    for key, g in before.groupby("series_key"):
        mine = after[after.series_key == key]
        assert ((mine.y - mine.yhat) ** 2).sum() <= ((g.y - g.yhat) ** 2).sum() * 1.001


def test_segments_are_sorted(spark):
    seg = _run(spark, "segments")
    assert seg.revenue.is_monotonic_decreasing


def test_stages_are_read_without_a_job(spark):
    """Once stages exist, a query that fits nothing plans without running anything."""
    for name in ("daily_revenue", "kpis", "insights", "ensemble_weights", "clean_audit", "eda_report", "segment_exposure"):
        R.QUERIES[name](spark, SF_SMALL)
        group = f"plan-{name}"
        spark.sparkContext.setJobGroup(group, name)
        R.QUERIES[name](spark, SF_SMALL)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
