import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators.quantiles import exact_quantiles, multi_quantiles


def test_grouped_quantiles_match_numpy_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = []
    # hot group holds a third of the rows and many ties
    for i in range(3000):
        rows.append(("hot", float(rng.integers(0, 50))))
    for g in range(60):
        for i in range(int(rng.integers(1, 120))):
            rows.append((f"g{g}", float(round(rng.uniform(0, 1000), 2))))
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p01": 0.01, "p33": 0.33, "p50": 0.5, "p995": 0.995}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    vals = {}
    for k, v in rows:
        vals.setdefault(k, []).append(v)
    for k, vs in vals.items():
        for name, q in probs.items():
            assert abs(getattr(got[k], name) - np.percentile(vs, q * 100)) < 1e-9, (k, name)


def test_large_group_uses_bracket(spark):
    rng = np.random.default_rng(5)
    vs = rng.normal(100, 30, 50_000).round(3)
    df = spark.createDataFrame([(float(x),) for x in vs], "v double")
    r = exact_quantiles(df, "v", {"a": 0.33, "b": 0.66}, accuracy=1000).first()
    assert abs(r.a - np.percentile(vs, 33)) < 1e-9 and abs(r.b - np.percentile(vs, 66)) < 1e-9


def test_multi_measure(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 30.0), ("a", 4.0, 20.0)], "k string, x double, y double")
    r = multi_quantiles(df, {"mx": ("x", 0.5), "my": ("y", 0.5)}, ["k"]).first()
    assert r.mx == 2.0 and r.my == 20.0


def test_many_distinct_values_in_a_bracket_are_ranked_in_ranges(spark):
    from ledgerlight.operators.quantiles import _counted
    n = 300_000
    df = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    vals = df.select("g", F.col("v").alias("_v"))
    inside = _counted(vals, ["g"], [0.5], 10, False).where("_side = 1")
    sizes = [r["count"] for r in inside.groupBy("_part").count().collect()]
    assert sum(sizes) >= 200_000 and max(sizes) <= 0.35 * sum(sizes) and len(sizes) >= 5
    got = exact_quantiles(df, "v", {"q": 0.5, "r": 0.123}, ["g"], accuracy=10).first()
    assert (got.q, got.r) == ((n - 1) * 0.5, pytest.approx((n - 1) * 0.123))
    fine = _counted(vals, ["g"], [0.5], 200, False).where("_side = 1").groupBy("_part").count().collect()
    assert len(fine) >= 4


@pytest.mark.parametrize("accuracy", [5, 40, 100_000])
def test_ranges_with_ties_and_many_groups(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    rows = [(int(g), float(v)) for g in range(6) for v in rng.choice([1.0, 2.0, 2.5, 7.0, rng.normal()], rng.integers(1, 400))]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.995, "e": 1.0}
    for r in exact_quantiles(df, "v", probs, ["g"], accuracy=accuracy).collect():
        mine = [v for g, v in rows if g == r.g]
        np.testing.assert_allclose([r[k] for k in probs], np.quantile(mine, list(probs.values())), rtol=1e-12)


def test_small_groups_are_sorted_and_large_ones_ranked(spark, monkeypatch):
    from ledgerlight.operators import quantiles
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 40)
    rng = np.random.default_rng(11)
    sizes = {"a": 1, "b": 2, "c": 40, "d": 41, "e": 3000, "none": 0}
    rows = [(g, float(round(rng.uniform(0, 9), 1)), float(rng.normal())) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows + [("a", None, None), ("none", None, None)], "k string, x double, y double")
    spec = {"x50": ("x", 0.5), "y50": ("y", 0.5), "y99": ("y", 0.99)}
    got = {r.k: r for r in multi_quantiles(df, spec, ["k"], sort_small=True).collect()}
    assert got == {r.k: r for r in multi_quantiles(df, spec, ["k"]).collect()}
    assert set(got) == set(sizes) - {"none"}
    for g in got:
        for name, (col, q) in spec.items():
            mine = [r[1 if col == "x" else 2] for r in rows if r[0] == g]
            assert getattr(got[g], name) == pytest.approx(np.quantile(mine, q), rel=1e-12)


@pytest.mark.parametrize("shift", [-0.3, -0.02, 0.001, 0.02, 0.3])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_a_wrong_sketch_does_not_matter(spark, monkeypatch, shift, groups):
    """Merged sketches can be wrong by more than they state: the result is exact wherever the cuts are."""
    from ledgerlight.operators import quantiles
    sketch = F.percentile_approx
    rng = np.random.default_rng(17)
    vs = rng.gamma(2.0, 300.0, 20_000).round(2)
    df = spark.createDataFrame([("g", float(v)) for v in vs], "g string, v double")
    bias = float(np.quantile(vs, 0.5 + shift) - np.median(vs))
    monkeypatch.setattr(quantiles.F, "percentile_approx",
                        lambda *a: F.transform(sketch(*a), lambda c: c + F.lit(bias)))
    got = exact_quantiles(df, "v", {"a": 0.33, "b": 0.5, "c": 0.995}, groups).first()
    np.testing.assert_allclose([got.a, got.b, got.c], np.quantile(vs, [0.33, 0.5, 0.995]), rtol=1e-12)
