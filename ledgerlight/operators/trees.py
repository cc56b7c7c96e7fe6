"""Boosted-tree forecaster on MLlib.

One global ``GBTRegressor`` is fitted over every series' rows (distributed
histogram passes).  The number of rounds is chosen by early stopping with
patience: a first fit leaves out the last rows of each series' training part,
its error on them is evaluated after every round, and the final fit of all
training rows has as many rounds as were best.

The recursive forecast is sequential in the horizon and parallel in the
series: each series is one state row (last 90 revenues, last 28 discounts,
running ewm, and the calendar features of every horizon date computed once up
front).  One narrow pass over these rows makes all steps, with the trees as
small arrays that every task gets; their size is bounded by rounds and depth.

Differences from the reference's XGBoost (documented, not hidden): no L1/L2
terms, fewer rounds at a higher rate by default, and the rows that stop the
rounds are not those of the holdout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.calendar import calendar_columns, fourier_columns
from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.calendar import HOLIDAY_CAP, holiday_distance
from ledgerlight.operators.daily import DAILY_AGG_COLUMNS
from ledgerlight.operators.forecast import error_metrics, floor0, index_rows
from ledgerlight.operators.series import EWM_SPAN, holdout_rows
from ledgerlight.session import ensure_checkpoint_dir

# The reference's model feature list and its barred columns.
FEATURE_COLS = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    "is_weekend", "is_month_start", "is_month_end", "is_quarter_end",
    "is_q4", "days_in_month", "days_to_quarter_end",
    "days_to_holiday", "near_holiday",
    "sin_week", "cos_week", "sin_year", "cos_year",
    "roll_mean_7d", "roll_std_7d",
    "roll_mean_14d", "roll_std_14d",
    "roll_mean_28d", "roll_std_28d",
    "roll_mean_90d", "roll_std_90d",
    "lag_7d", "lag_14d", "lag_28d", "lag_56d",
    "momentum_7_28", "ewm_14d",
    "avg_discount",
]
LEAKY_COLS = [
    "gross_profit", "n_transactions", "n_customers", "n_products",
    "avg_order_value", "avg_quantity", "recurring_rev", "gp_margin",
    "recurring_share", "rev_per_customer",
    "rev_consumer", "rev_corporate", "rev_home office",
    "rev_furniture", "rev_office supplies", "rev_technology",
]


#: Same-day aggregates that may feed the model: known before the day's sales.
KNOWN_AHEAD = ("avg_discount",)


def barred_columns(cols: Sequence[str]) -> set[str]:
    """Columns made of the same day's sales: the daily aggregates, and every
    column of a revenue breakdown, whatever value of the data it is named after."""
    own = (set(DAILY_AGG_COLUMNS) | set(LEAKY_COLS)) - set(KNOWN_AHEAD)
    return {c for c in cols if c in own or c.startswith("rev_")}


def check_no_leaks(cols: Sequence[str]) -> None:
    """No same-day revenue-derived column may be a model input."""
    barred = barred_columns(cols)
    if barred:
        raise ValueError(f"not known before the day's sales: {', '.join(sorted(barred))}")


def assembler(cols: Sequence[str] = FEATURE_COLS) -> VectorAssembler:
    check_no_leaks(cols)
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def with_vectors(df: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """``df`` with its feature vectors, unless it has them already (from a table written once for many fits)."""
    return df if "features" in df.columns else assembler(cols).transform(df)


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit: depth 5, min 3 rows per leaf, 0.8 row and column
    sampling, at most ``rounds`` rounds at ``rate``.  ``patience`` rounds
    without a smaller error on the last ``validation_rows`` rows of each
    series stop it; without patience all rounds are made."""
    rounds: int = 40
    rate: float = 0.1
    patience: int | None = 8
    validation_rows: int = 60
    depth: int = 5
    seed: int = 42

    def estimator(self, rounds: int | None = None) -> GBTRegressor:
        return GBTRegressor(featuresCol="features", labelCol="revenue", predictionCol="prediction",
                            maxIter=rounds or self.rounds, stepSize=self.rate, maxDepth=self.depth,
                            minInstancesPerNode=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=self.seed)


def best_round(errors: Sequence[float], patience: int) -> int:
    """Rounds up to the smallest error, of those made before ``patience`` rounds passed without a smaller one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit(train: DataFrame, cols: Sequence[str] = FEATURE_COLS, settings: Boosting = Boosting()):
    """M1: the model of all rows of ``train``, with the rounds that early stopping finds."""
    train, rounds = with_vectors(train, cols), settings.rounds
    if settings.patience is not None:
        split = holdout_rows(train, settings.validation_rows)
        learnt, kept_out = (split.where(F.col("split") == part) for part in ("train", "holdout"))
        if not learnt.isEmpty():  # else every series is shorter than what is kept out
            staged = settings.estimator().fit(learnt)
            rounds = best_round(staged.evaluateEachIteration(kept_out, "squared"), settings.patience)
    return settings.estimator(rounds).fit(train)


def holdout_eval(base: DataFrame, holdout: int = 90, cols: Sequence[str] = FEATURE_COLS,
                 settings: Boosting = Boosting()):
    """Fit on all but the last ``holdout`` rows of every series, score the
    holdout rows (predictions floored at 0).  Returns (model, predictions,
    metrics)."""
    split = holdout_rows(with_vectors(base, cols), holdout)
    model = fit(split.where(F.col("split") == "train"), cols, settings)
    pred = (model.transform(split.where(F.col("split") == "holdout"))
            .select("series_key", "date", F.col("revenue").alias("y"), floor0("prediction").alias("yhat")))
    return model, pred, error_metrics(pred, ["series_key"])


def importance(spark: SparkSession, model, cols: Sequence[str] = FEATURE_COLS, top: int = 20) -> DataFrame:
    """Importances with rank and score relative to the top one."""
    imp = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    df = spark.createDataFrame(imp, "feature string, importance double")
    mx = df.agg(F.max("importance").alias("_mx"))
    from ledgerlight.operators.quantiles import with_scalars
    ranked = with_scalars(df, mx).select(
        "feature", rh("importance", 6).alias("importance"),
        rh(F.try_divide(F.col("importance"), F.col("_mx")), 4).alias("relative"))
    return ranked.orderBy(F.col("importance").desc(), "feature").limit(top)


def _tail(values, k: int):
    """The last ``k`` elements, or all of a shorter array."""
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), k)


def _state(base: DataFrame) -> DataFrame:
    """Initial state per series from the history."""
    alpha = 2.0 / (EWM_SPAN + 1.0)
    idx = index_rows(base)
    last = idx.where(F.col("rn") == F.col("n")).select(
        "series_key", F.col("date").alias("last_date"),
        F.when(F.col("ewm_14d").isNull(), F.col("revenue"))
         .otherwise(F.col("ewm_14d") * (1 - alpha) + F.col("revenue") * alpha).alias("ewm"))
    tail = idx.where(F.col("rn") > F.col("n") - 90).groupBy("series_key").agg(
        F.sort_array(F.collect_list(F.struct("date", "revenue"))).alias("_h"),
        F.sort_array(F.collect_list(F.struct("date", "avg_discount"))).alias("_d"))
    return last.join(tail, "series_key").select(
        "series_key", "last_date", "ewm",
        F.transform("_h", lambda s: s["revenue"]).alias("hist"),
        _tail(F.transform("_d", lambda s: s["avg_discount"]), 28).alias("disc"))


CAL_FEATURES = FEATURE_COLS[:FEATURE_COLS.index("cos_year") + 1]


def _calendar_plan(state: DataFrame, holidays: DataFrame, horizon: int) -> DataFrame:
    """Calendar and holiday features of every forecast date, computed once:
    one array of ``horizon`` structs per series (bounded by the horizon)."""
    from ledgerlight.operators.series import future_spine
    spine = future_spine(state.select("series_key", "last_date"), horizon)
    cal = spine.withColumns(calendar_columns("date")).withColumns(fourier_columns("date"))
    cal = cal.join(holiday_distance(holidays), "date", "left").withColumn(
        "days_to_holiday", F.coalesce("days_to_holiday", F.lit(HOLIDAY_CAP)).cast("int"))
    cal = cal.withColumn("near_holiday", (F.col("days_to_holiday") <= 3).cast("int"))
    return cal.groupBy("series_key").agg(
        F.sort_array(F.collect_list(F.struct("h", "date", *CAL_FEATURES))).alias("cal"))


class Forest:
    """The trees of a model as arrays: for each tree and node the feature it
    splits (-1: a leaf), the threshold, the nodes to either side, the value."""

    def __init__(self, nodes: Sequence, weights: Sequence[float]) -> None:
        import numpy as np

        shape = (len(weights), 1 + max(n["id"] for n in nodes))
        self.feature = np.full(shape, -1, dtype=np.int32)
        self.threshold, self.value = np.zeros(shape), np.zeros(shape)
        self.left, self.right = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        self.weights = np.asarray(weights)
        for n in nodes:
            at = n["tree"], n["id"]
            self.value[at] = n["prediction"]
            if n["feature"] >= 0:
                if n["categories"] >= 0:
                    raise ValueError("splits by category are not supported")
                self.feature[at], self.threshold[at] = n["feature"], n["threshold"]
                self.left[at], self.right[at] = n["left"], n["right"]

    def predict(self, x):
        """Of each row of a matrix of features."""
        import numpy as np

        tree, row = np.arange(len(self.weights))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.weights), len(x)), dtype=np.int32)
        while True:
            feature = self.feature[tree, node]
            if (feature < 0).all():
                return self.weights @ self.value[tree, node]
            goes_left = x[row, feature] <= self.threshold[tree, node]
            below = np.where(goes_left, self.left[tree, node], self.right[tree, node])
            node = np.where(feature < 0, node, below)


def forest(spark: SparkSession, model) -> Forest:
    """The arrays of a fitted model, read from its saved tables; their size is bounded by rounds and depth."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlight-models/{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["split"]["numCategories"].alias("categories")).collect()
    return Forest(nodes, model.treeWeights)


class Tails:
    """The last ``width`` values of many series, right-aligned; shorter ones have fewer."""

    def __init__(self, lists, width: int) -> None:
        import numpy as np

        self.values = np.zeros((len(lists), width))
        self.count = np.array([min(len(v), width) for v in lists])
        for i, v in enumerate(lists):
            self.values[i, width - self.count[i]:] = v[len(v) - self.count[i]:]

    def append(self, new) -> None:
        import numpy as np

        self.values = np.column_stack([self.values[:, 1:], new])
        self.count = np.minimum(self.count + 1, self.values.shape[1])

    def mean(self, k: int):
        import numpy as np

        return self.values[:, -k:].sum(axis=1) / np.minimum(self.count, k)  # zeros stand before short ones

    def std(self, k: int):
        import numpy as np

        n, width = np.minimum(self.count, k), self.values.shape[1]
        there = np.arange(width)[None, -k:] >= width - n[:, None]
        far = np.where(there, self.values[:, -k:] - self.mean(k)[:, None], 0.0)
        return np.sqrt((far * far).sum(axis=1) / np.maximum(n - 1, 1)) * (n > 1)

    def lag(self, k: int):
        import numpy as np

        width = self.values.shape[1]
        return np.where(self.count >= k, self.values[:, -k], self.mean(width))


def step_features(hist: Tails, disc: Tails, ewm, calendar: dict) -> dict:
    """The model's features of the next day of every series."""
    import numpy as np

    out = dict(calendar, avg_discount=disc.mean(28), ewm_14d=ewm)
    for w in (7, 14, 28, 90):
        out[f"roll_mean_{w}d"], out[f"roll_std_{w}d"] = hist.mean(w), hist.std(w)
    for lag in (7, 14, 28, 56):
        out[f"lag_{lag}d"] = hist.lag(lag)
    short, long = out["roll_mean_7d"], out["roll_mean_28d"]
    out["momentum_7_28"] = np.where(long > 0, short / np.where(long > 0, long, 1.0), 1.0)
    return out


#: Series whose steps are made together.
SERIES_AT_ONCE = 1024


def recursive_forecast(spark: SparkSession, model, base: DataFrame, holidays: DataFrame,
                       horizon: int = 90, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M4 + U1: each day's prediction feeds the next day's lags, windows and
    ewm.  The state is bounded per series (90 values, 28 discounts, one ewm),
    so all days of all series are one pass over the state rows."""
    alpha = 2.0 / (EWM_SPAN + 1.0)
    trees, cols = forest(spark, model), list(cols)
    state = _state(base)
    state = state.join(_calendar_plan(state, holidays, horizon), "series_key").select(
        "series_key", "cal", "ewm", "hist", "disc")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, SERIES_AT_ONCE):
                batch = whole.slice(start, SERIES_AT_ONCE)
                n = batch.num_rows
                cal = batch.column("cal").flatten()
                days = {f: cal.field(f).to_numpy(zero_copy_only=False).reshape(n, horizon) for f in CAL_FEATURES}
                hist, disc = Tails(batch.column("hist").to_pylist(), 90), Tails(batch.column("disc").to_pylist(), 28)
                ewm = batch.column("ewm").to_numpy(zero_copy_only=False)
                made = np.zeros((n, horizon))
                for step in range(horizon):
                    feats = step_features(hist, disc, ewm, {f: v[:, step] for f, v in days.items()})
                    yhat = np.maximum(trees.predict(np.column_stack([feats[c] for c in cols])), 0.0)
                    made[:, step] = yhat
                    disc.append(feats["avg_discount"])
                    hist.append(yhat)
                    ewm = ewm * (1 - alpha) + yhat * alpha
                yield pa.RecordBatch.from_arrays(
                    [batch.column("series_key").take(pa.array(np.repeat(np.arange(n), horizon))), cal.field("date"),
                     pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), n)), pa.array(made.ravel())],
                    ["series_key", "date", "h", "yhat"])

    return (state.mapInArrow(run, "series_key string, date date, h int, yhat double")
            .withColumn("yhat", rh("yhat", 2)))


def cv_scores(base: DataFrame, folds: DataFrame, cols: Sequence[str] = FEATURE_COLS,
              max_workers: int = 5, settings: Boosting = Boosting()) -> DataFrame:
    """M2 scores: one global model per fold (rows up to the fold's train end
    in every series), scored on the fold's test rows.  Folds are independent
    Spark jobs submitted from a small driver thread pool so they share the
    cluster; each job is distributed as usual."""
    from concurrent.futures import ThreadPoolExecutor

    idx = index_rows(with_vectors(base, cols))
    fold_ids = [r[0] for r in folds.select("fold").distinct().collect()]  # at most n_splits values
    assigned = (idx.join(folds, "series_key").where(F.col("rn") <= F.col("test_end"))
                   .withColumn("_test", F.col("rn") > F.col("train_end")))

    def one(f):
        rows = assigned.where(F.col("fold") == f)
        model = fit(rows.where(~F.col("_test")), cols, settings)
        pred = model.transform(rows.where(F.col("_test")))
        return pred.select("series_key", F.lit(f).alias("fold"), F.col("revenue").alias("y"),
                           floor0("prediction").alias("yhat")).checkpoint(eager=True)

    ensure_checkpoint_dir(base.sparkSession)
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        parts = list(pool.map(one, sorted(fold_ids)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return error_metrics(out, ["series_key", "fold"])
