"""Fits from summed outer products against fits of the rows themselves."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import additive as AD
from ledgerlight.operators.gram import gram_sums, linear, running_sums, solve
from ledgerlight.operators.ridge import REGRESSORS
from ledgerlight.sources.holidays import us_holidays


def _closed_form(x, y, alpha, standardise):
    mean = x.mean(0)
    sd = x.std(0) if standardise else np.ones(x.shape[1])
    sd[sd == 0] = 1
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return beta, y.mean() - beta @ mean


def _rows(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for a, b, n in (("x", 1, 400), ("x", None, 30), (None, 2, 5), ("y", 1, 1), ("y", 2, 700)):
        for _ in range(n):
            v = rng.normal(size=3)
            out.append((a, b, float(v[0]) * 1e5 + 1e6, float(v[1]), 4.0, float(v @ [3e-5, 2, 0] + v[2])))
    out += [("x", 1, None, 1.0, 4.0, 2.0), ("x", 1, 1.0, 1.0, 4.0, None)]
    return out


@pytest.mark.parametrize("standardise", [False, True])
def test_solutions_of_all_groups(spark, standardise, monkeypatch):
    import ledgerlight.operators.gram as G
    monkeypatch.setattr(G, "HELD_GROUPS", 2)
    rows = _rows()
    df = spark.createDataFrame(rows, "a string, b int, p double, q double, r double, y double").repartition(5)
    sums = gram_sums(df, ["a", "b"], ["p", "q", "r"], "y")
    got = {(r.a, r.b): r for r in solve(sums, ["a", "b"], 3, 0.5, standardise).collect()}
    groups = {}
    for a, b, *v in rows:
        if None not in v:
            groups.setdefault((a, b), []).append(v)
    assert set(got) == set(groups)
    for key, v in groups.items():
        v = np.array(v)
        beta, icpt = _closed_form(v[:, :3].copy(), v[:, 3], 0.5, standardise)
        assert got[key].n == len(v)
        np.testing.assert_allclose([*got[key].coef, got[key].intercept], [*beta, icpt], rtol=1e-5, atol=1e-7)
    assert solve(gram_sums(df.limit(0), ["a", "b"], ["p"], "y"), ["a", "b"], 1).count() == 0


def test_no_pandas_group_and_no_window_of_rows(spark):
    df = spark.createDataFrame(_rows(), "a string, b int, p double, q double, r double, y double")
    plan = solve(gram_sums(df, ["a"], ["p", "q"], "y"), ["a"], 2)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "FlatMapGroupsInArrow" not in plan


def test_running_sums(spark):
    df = spark.createDataFrame([("s", f, float(x), 2.0 * x) for f, x in ((0, 1), (0, 2), (2, 5), (4, 7))],
                               "k string, fold int, x double, y double")
    groups = spark.createDataFrame([("s", f) for f in range(5)], "k string, fold int")
    out = running_sums(gram_sums(df, ["k", "fold"], ["x"], "y"), groups, ["k"], "fold", 1)
    n = {r.fold: r.value for r in out.where("place = 0").collect()}
    sx = {r.fold: r.value for r in out.where("place = 1").collect()}
    assert n == {0: 4, 1: 2, 2: 2, 3: 1, 4: 1} and sx == {0: 15, 1: 12, 2: 12, 3: 7, 4: 7}


def test_linear(spark):
    df = spark.createDataFrame([(1.0, 2.0, [3.0, 4.0], 0.5)], "x double, z double, coef array<double>, intercept double")
    assert df.select(linear(["x", "z"]).alias("v")).first().v == 11.5


def _base(spark, lengths=(("a", 330), ("b", 260), ("short", 40))):
    rng = np.random.default_rng(7)
    rows = []
    for key, n in lengths:
        day = dt.date(2022, 3, 1)
        for i in range(n):
            day += dt.timedelta(days=1 if rng.random() < 0.85 else 3)
            rows.append((key, day, round(math.exp(5 + 0.2 * math.sin(i / 9) + rng.normal(0, 0.1)), 2),
                         int(day.month >= 10), int(rng.random() < 0.1), float(rng.normal(150, 20)), float(rng.random() / 10)))
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double, is_q4 int, near_holiday int, "
                                     "roll_mean_28d double, avg_discount double")
    hol = us_holidays(spark.createDataFrame([(y,) for y in range(2021, 2026)], "year int"))
    return df, hol


def test_additive_equals_the_closed_form(spark):
    df, hol = _base(spark)
    cols = AD.design_columns()
    cut = dt.date(2022, 12, 1)
    train, rows = df.where(F.col("date") <= cut), df.where(F.col("date") > cut)
    got = {(r.series_key, r.date): r for r in
           AD.fit_predict(train, rows.select("series_key", "date", *REGRESSORS), hol).collect()}
    first = AD.first_dates(train)
    design = AD.add_design(df, first, hol).toPandas()
    assert len(got) == (design.date > cut).sum()
    for key, g in design.groupby("series_key"):
        t, p = g[g.date <= cut], g[g.date > cut]
        beta, icpt = _closed_form(t[cols].to_numpy(float), np.log1p(t.revenue.to_numpy()), 1.0, True)
        far = np.abs(np.log1p(t.revenue.to_numpy()) - t[cols].to_numpy(float) @ beta - icpt)
        band = np.quantile(far, 0.9)
        eta = p[cols].to_numpy(float) @ beta + icpt
        for day, e in zip(p.date, eta):
            r = got[key, day]
            np.testing.assert_allclose([r.yhat, r.yhat_lower, r.yhat_upper],
                                       np.maximum(np.expm1([e, e - band, e + band]), 0), atol=0.0051, rtol=1e-6)


def test_rolling_origin_scores_equal_refits(spark):
    df, hol = _base(spark)
    got = {(r.series_key, r.fold): r for r in AD.rolling_origin_scores(df, hol, 150, 25, 40).collect()}
    cuts = {(r.series_key, r.fold): r.cutoff for r in AD.origin_cutoffs(df, 150, 25, 40).collect()}
    assert set(got) == set(cuts) and len(cuts) > 8 and not any(k[0] == "short" for k in cuts)
    for (key, fold), cutoff in sorted(cuts.items())[::3]:
        mine = df.where(F.col("series_key") == key)
        test = mine.where((F.col("date") > cutoff) & (F.col("date") <= cutoff + dt.timedelta(days=40)))
        fc = AD.fit_predict(mine.where(F.col("date") <= cutoff), test.select("series_key", "date", *REGRESSORS), hol)
        both = test.join(fc, ["series_key", "date"]).toPandas()
        e = both.revenue - both.yhat
        r = got[key, fold]
        assert r.n_eval == len(both)
        np.testing.assert_allclose([r.rmse, r.mae, r.mape],
                                   [math.sqrt((e ** 2).mean()), e.abs().mean(), (e.abs() / both.revenue).mean() * 100],
                                   rtol=1e-3)
