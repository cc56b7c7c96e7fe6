from ledgerlight.operators.ensemble import inverse_rmse_weights, winner


def _w(spark, a, b):
    df = spark.createDataFrame([("s", "a", float(a)), ("s", "b", float(b))], "series_key string, model string, rmse double")
    return {r.model: r.weight for r in inverse_rmse_weights(df).collect()}


def test_weights_sum_to_one(spark):
    w = _w(spark, 100, 200)
    assert abs(w["a"] + w["b"] - 1) < 1e-9


def test_lower_rmse_higher_weight(spark):
    w = _w(spark, 100, 300)
    assert w["a"] > w["b"]


def test_equal_rmse_equal_weights(spark):
    w = _w(spark, 150, 150)
    assert abs(w["a"] - w["b"]) < 1e-9


def test_weights_positive_and_extreme(spark):
    w = _w(spark, 500, 1500)
    assert w["a"] > 0 and w["b"] > 0
    w = _w(spark, 10, 10000)
    assert w["a"] > 0.99 and w["b"] > 0


def test_winner_needs_strictly_better_ensemble(spark):
    m = spark.createDataFrame([("s", "a", 10.0), ("s", "b", 12.0)], "series_key string, model string, rmse double")
    e1 = spark.createDataFrame([("s", 10.0)], "series_key string, rmse double")
    e2 = spark.createDataFrame([("s", 9.0)], "series_key string, rmse double")
    assert winner(m, e1).first().winner == "a"
    assert winner(m, e2).first().winner == "ensemble"
