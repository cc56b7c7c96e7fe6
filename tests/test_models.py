import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.operators.clean import keep_first
from ledgerlight.operators.decompose import seasonal_forecast
from ledgerlight.operators.ridge import fit_residual_ridge


def test_decomposition_recovers_weekly_pattern(spark):
    start = dt.date(2020, 1, 6)  # a Monday
    pattern = [100.0, 120.0, 90.0, 80.0, 150.0, 60.0, 40.0]
    rows = [("s", start + dt.timedelta(days=i), pattern[i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double")
    fc = seasonal_forecast(df, horizon=14, periods=(7,)).orderBy("h").toPandas()
    want = [pattern[(70 + i) % 7] for i in range(14)]
    np.testing.assert_allclose(fc["yhat"], want, atol=0.02)


def test_decomposition_follows_linear_trend(spark):
    start = dt.date(2021, 3, 1)
    rows = [("t", start + dt.timedelta(days=i), 1000.0 + 10.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double")
    fc = seasonal_forecast(df, horizon=3, periods=(7,)).orderBy("h").toPandas()
    np.testing.assert_allclose(fc["yhat"], [1600.0, 1610.0, 1620.0], atol=0.05)


def test_ridge_recovers_linear_relation(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, (b0, b1) in (("a", (2.0, -3.0)), ("b", (0.5, 4.0))):
        for _ in range(400):
            x1, x2 = rng.normal(), rng.normal()
            rows.append((key, float(b0 * x1 + b1 * x2 + 7.0), 0.0, float(x1), float(x2)))
    df = spark.createDataFrame(rows, "series_key string, y double, yhat double, x1 double, x2 double")
    coefs = {r.series_key: r for r in fit_residual_ridge(df, ["x1", "x2"], alpha=1e-9).collect()}
    assert abs(coefs["a"].b0 - 2.0) < 1e-6 and abs(coefs["a"].b1 + 3.0) < 1e-6
    assert abs(coefs["b"].b1 - 4.0) < 1e-6 and abs(coefs["b"].intercept - 7.0) < 1e-6


def test_keep_first_with_hot_key(spark):
    # one id holds a third of the rows: the aggregate still picks the first
    n = 3000
    hot = spark.range(n).select(F.lit("HOT").alias("transaction_id"), (n - F.col("id")).alias("o"),
                                F.col("id").cast("string").alias("v"))
    rest = spark.range(2 * n).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("transaction_id"),
                                     F.col("id").alias("o"), F.lit("x").alias("v"))
    out = keep_first(hot.unionByName(rest), "transaction_id", ["o"])
    assert out.count() == 2 * n + 1
    assert out.where("transaction_id = 'HOT'").first().v == str(n - 1)


def test_walk_forward_scores_equal_a_fit_of_each_fold(spark):
    from ledgerlight.operators.decompose import walk_forward_scores
    rng = np.random.default_rng(4)
    rows = []
    for key, n in (("a", 150), ("b", 110), ("short", 60)):
        day = dt.date(2022, 1, 1)
        for i in range(n):
            day += dt.timedelta(days=1 if rng.random() < 0.9 else 2)
            rows.append((key, day, round(float(200 + 30 * (i % 7) + i + rng.normal(0, 5)), 2)))
    df = spark.createDataFrame(rows, "series_key string, date date, revenue double")
    got = {(r.series_key, r.fold): r for r in
           walk_forward_scores(df, initial=70, step=20, horizon=15, max_folds=3, periods=(7,)).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    for (key, fold), r in got.items():
        mine = sorted(x[1:] for x in rows if x[0] == key)
        end = 70 + 20 * fold
        train = spark.createDataFrame([(key, *x) for x in mine[:end]], df.schema)
        fc = [x.yhat for x in seasonal_forecast(train, 15, periods=(7,)).orderBy("h").collect()]
        y = np.array([x[1] for x in mine[end:end + 15]])
        e = y - np.array(fc)
        assert r.n_eval == 15
        np.testing.assert_allclose([r.rmse, r.mae, r.mape],
                                   [np.sqrt((e ** 2).mean()), np.abs(e).mean(), (np.abs(e) / y).mean() * 100], rtol=1e-9)
