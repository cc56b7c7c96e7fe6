"""Registered queries (Spark) and their DuckDB twins.

Every query reads the driver's tables for ``sf_dir`` and runs over whole
tables.  Outputs are aliased and rounded identically in both engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.daily import aggregate_daily
from ledgerlight.plans import sql_twins as T
from ledgerlight.plans.pipeline import Params, clean_fact
from ledgerlight.sources.io import (load_gbt_model, read_metrics_json, read_report_json, save_model, write_raw_csv,
                                    write_report_json)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rh(c, d) for c, d in spec.items()})


DAILY_ROUND = {"revenue": 2, "gross_profit": 2, "avg_order_value": 2, "avg_discount": 4,
               "avg_quantity": 4, "recurring_rev": 2}
DAILY_COLS = ["series_key", "date", "revenue", "gross_profit", "n_transactions", "n_customers",
              "n_products", "avg_order_value", "avg_discount", "avg_quantity", "recurring_rev",
              "gp_margin", "recurring_share", "rev_per_customer"]


def _sql_daily_out(src: str = "daily") -> str:
    return f"""
SELECT series_key, date, {T.r('revenue')} AS revenue, {T.r('gross_profit')} AS gross_profit,
       n_transactions, n_customers, n_products,
       {T.r('avg_order_value')} AS avg_order_value, {T.r('avg_discount', 4)} AS avg_discount,
       {T.r('avg_quantity', 4)} AS avg_quantity, {T.r('recurring_rev')} AS recurring_rev,
       gp_margin, recurring_share, rev_per_customer
FROM {src}"""


# ---------------------------------------------------------------- daily (A1-A3)
@register("daily_revenue", T.fact_prefix() + T.daily_cte() + _sql_daily_out())
def q_daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = aggregate_daily(clean_fact(spark, sf_dir, Params()))
    return rounded(daily, DAILY_ROUND).select(*DAILY_COLS)


@register("csv_daily_revenue", ORACLE["daily_revenue"])
def q_csv_daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table written as a latin-1 CSV, and the daily series of that file."""
    from ledgerlight.plans import stages as _st
    from ledgerlight.plans.pipeline import csv_clean_fact, raw_table
    path = _st.folder(spark, ("raw_csv", sf_dir), lambda to: write_raw_csv(raw_table(spark, sf_dir), to))
    return rounded(aggregate_daily(csv_clean_fact(spark, path, Params())), DAILY_ROUND).select(*DAILY_COLS)


# ------------------------------------------------------------- shared pieces
from ledgerlight.operators import report as R  # noqa: E402
from ledgerlight.operators.clean import dirty_transactions  # noqa: E402
from ledgerlight.operators.daily import pivot_revenue  # noqa: E402
from ledgerlight.operators.ingest import (  # noqa: E402
    CUSTOMER_COLUMNS, PRODUCT_COLUMNS, TRANSACTION_COLUMNS, orphan_counts)
from ledgerlight.operators.series import drop_warmup  # noqa: E402
from ledgerlight.plans.pipeline import (  # noqa: E402
    category_values, clean_star, daily_features, segment_values, star, star_full)

# Segment and category names of the driver's test tables, for
# the DuckDB twins' pivot column lists (the Spark side reads them from the
# customer and part tables).
TEST_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TEST_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PIVOTS_SQL = {"segment": TEST_SEGMENTS, "category": TEST_CATEGORIES}

P = T.fact_prefix()
PD = T.fact_prefix(dirty=True)
STAR = "WITH " + T.star_ctes()


def _fact(spark, sf):
    return clean_star(spark, sf)[2]


_PIVOT_VALUES: dict = {}


def _breakdowns(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PIVOT_VALUES:
        _PIVOT_VALUES[key] = {"segment": segment_values(spark, sf), "category": category_values(spark, sf)}
    return _PIVOT_VALUES[key]


def _features(spark, sf, series=None, pivots=True):
    """Daily feature table per series, written once per session as a stage
    table (every window, forecast and report query reads it).  The total
    series without pivot columns is a projection of the one with them."""
    from ledgerlight.operators.daily import pivot_name
    from ledgerlight.plans import stages as _st
    if series is None and not pivots:
        full = _features(spark, sf, None, True)
        drop = {pivot_name("rev_", v) for vals in _breakdowns(spark, sf).values() for v in vals}
        return full.select(*[c for c in full.columns if c not in drop])
    key = ("features", sf, series, pivots)
    return _st.stage(spark, key, lambda: daily_features(
        _fact(spark, sf), series, _breakdowns(spark, sf) if pivots else None,
        materialize=lambda d: _st.stage(spark, ("daily",) + key[1:], lambda: d)))


def _daily(spark, sf, series=None):
    """Daily aggregate per series, read from the staged feature table."""
    from ledgerlight.operators.daily import DAILY_AGG_COLUMNS
    return _features(spark, sf, series, pivots=False).select("series_key", "date", *DAILY_AGG_COLUMNS)


def feat_sql(series=None, pivots=None, prefix=None) -> str:
    return ((prefix or P) + T.daily_cte(series, pivots) + T.holidays_cte("daily") + f""",
feat0 AS (
  SELECT d.*, {T.calendar_select('d')},
    {T.rolling_select('revenue', 'd')}
  FROM daily d LEFT JOIN hol_dist h ON d.date = h.date
),
feat AS (
  SELECT * EXCLUDE (_prev),
    {T.r('coalesce(roll_mean_7d / nullif(roll_mean_28d, 0), 1.0)', 4)} AS momentum_7_28,
    {T.ewm_expr('_prev')} AS ewm_14d
  FROM feat0
)""")


CAL_COLS = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
            "is_weekend", "is_month_start", "is_month_end", "is_quarter_end", "is_q4",
            "days_in_month", "days_to_quarter_end", "days_to_holiday", "near_holiday"]
FOURIER = ["sin_week", "cos_week", "sin_year", "cos_year"]
ROLL_COLS = [f"roll_{k}_{n}d" for n in (7, 14, 28, 90) for k in ("mean", "std")]
LAG_COLS = [f"lag_{n}d" for n in (7, 14, 28, 56)]


def feature_numeric(pivot_columns: list[str]) -> list[str]:
    """Numeric columns of the feature table, given those of its breakdowns."""
    return (["gross_profit", "n_transactions", "n_customers", "n_products", "avg_order_value",
             "avg_discount", "avg_quantity", "recurring_rev"] + pivot_columns +
            ["gp_margin", "recurring_share", "rev_per_customer"] + CAL_COLS + FOURIER +
            ROLL_COLS + LAG_COLS + ["momentum_7_28", "ewm_14d"])


#: Of the test tables, for the DuckDB twins.
FEATURE_NUMERIC = feature_numeric([f"rev_{v.lower()}" for v in TEST_SEGMENTS + TEST_CATEGORIES])


def _numeric(features: DataFrame) -> list[str]:
    """Numeric columns of a feature table, whatever values its breakdowns have."""
    return feature_numeric([c for c in features.columns if c.startswith("rev_") and c != "rev_per_customer"])


# ---------------------------------------------------------- star
@register("customer_dim", STAR + "\nSELECT * FROM customers")
def q_customer_dim(spark, sf):
    return star(spark, sf)[0].select(*CUSTOMER_COLUMNS)


@register("product_dim", STAR + "\nSELECT product_id, category, base_price, margin_pct, is_recurring, "
          "n_orders, unique_customers FROM products")
def q_product_dim(spark, sf):
    return star_full(spark, sf)[1].select(*PRODUCT_COLUMNS, "n_orders", "unique_customers")


@register("transaction_fact", STAR + "\nSELECT " + ", ".join(TRANSACTION_COLUMNS) + " FROM txn")
def q_transaction_fact(spark, sf):
    return star(spark, sf)[2].select(*TRANSACTION_COLUMNS)


# ---------------------------------------------------------- clean
@register("clean_transactions", PD + "\nSELECT " + ", ".join(TRANSACTION_COLUMNS) + " FROM fact")
def q_clean_transactions(spark, sf):
    return clean_star(spark, sf, dirty=True)[2].select(*TRANSACTION_COLUMNS)


@register("clean_fact", P + "\nSELECT " + ", ".join(TRANSACTION_COLUMNS) + " FROM fact")
def q_clean_fact(spark, sf):
    return _fact(spark, sf).select(*TRANSACTION_COLUMNS)


@register("clean_customer_dim", P + "\nSELECT * FROM clean_customers")
def q_clean_customer_dim(spark, sf):
    return clean_star(spark, sf)[0].select(*CUSTOMER_COLUMNS)


@register("clean_product_dim", P + "\nSELECT * FROM clean_products")
def q_clean_product_dim(spark, sf):
    return clean_star(spark, sf)[1].select(*PRODUCT_COLUMNS)


@register("clean_audit", PD + f"""
SELECT (SELECT count(*) FROM txn_in) AS rows_in,
       (SELECT count(*) FROM txn_in) - (SELECT count(*) FROM deduped) AS removed_duplicates,
       (SELECT count(*) FROM deduped) - (SELECT count(*) FROM positive) AS removed_non_positive,
       (SELECT count(*) FROM positive) - (SELECT count(*) FROM non_null) AS removed_null_critical,
       (SELECT count(*) FROM non_null) - (SELECT count(*) FROM fact) AS removed_orphans,
       (SELECT count(*) FROM fact) AS rows_out,
       (SELECT CAST(sum(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM typed) AS unparsable_quantity,
       (SELECT CAST(sum(CASE WHEN discount_pct >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) FROM final) AS discount_at_cap,
       (SELECT {T.r('avg(revenue)')} FROM positive) AS mean_revenue_before_cap,
       (SELECT {T.r('avg(revenue)')} FROM capped) AS mean_revenue_after_cap""")
def q_clean_audit(spark, sf):
    from ledgerlight.plans.pipeline import clean_audit_table
    return clean_audit_table(spark, sf, dirty=True)


@register("fk_orphans", STAR + T.DIRTY + """
SELECT (SELECT count(*) FROM txn_in t WHERE t.customer_id NOT IN (SELECT customer_id FROM customers))
         AS orphan_customer_rows,
       (SELECT count(*) FROM txn_in t WHERE t.product_id NOT IN (SELECT product_id FROM products))
         AS orphan_product_rows""")
def q_fk_orphans(spark, sf):
    customers, products, txn = star(spark, sf)
    return orphan_counts(dirty_transactions(txn), customers, products)


@register("fk_semi", PD + """
SELECT count(*) AS rows_kept, count(DISTINCT customer_id) AS customers_kept,
       count(DISTINCT product_id) AS products_kept FROM fact""")
def q_fk_semi(spark, sf):
    return clean_star(spark, sf, dirty=True)[2].agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.countDistinct("customer_id").alias("customers_kept"),
        F.countDistinct("product_id").alias("products_kept"))


# ---------------------------------------------------------- calendar
@register("calendar_features", P + T.daily_cte() + T.holidays_cte("daily") + f"""
SELECT date, {', '.join(CAL_COLS)}, {', '.join(f'{T.r(c, 6)} AS {c}' for c in FOURIER)}
FROM (SELECT d.date, {T.calendar_select('d')} FROM daily d LEFT JOIN hol_dist h ON d.date = h.date)""")
def q_calendar_features(spark, sf):
    f = _features(spark, sf, pivots=False)
    return rounded(f.select("date", *CAL_COLS, *FOURIER), {c: 6 for c in FOURIER})


@register("holiday_calendar", P + T.daily_cte() + T.holidays_cte("daily") +
          "\nSELECT holiday, ds FROM holidays")
def q_holiday_calendar(spark, sf):
    from ledgerlight.sources.holidays import us_holidays, years_spanned
    return us_holidays(years_spanned(_daily(spark, sf)))


# ---------------------------------------------------------- windows
@register("rolling_features", feat_sql("segment") + f"""
SELECT series_key, date, revenue, {', '.join(f'{T.r(c)} AS {c}' for c in ROLL_COLS)}, momentum_7_28
FROM feat""")
def q_rolling_features(spark, sf):
    f = _features(spark, sf, "segment", pivots=False)
    return rounded(f.select("series_key", "date", "revenue", *ROLL_COLS, "momentum_7_28"),
                   {c: 2 for c in ROLL_COLS})


@register("lag_features", feat_sql("segment") + f"""
SELECT series_key, date, revenue, {', '.join(LAG_COLS)} FROM feat WHERE lag_56d IS NOT NULL""")
def q_lag_features(spark, sf):
    f = drop_warmup(_features(spark, sf, "segment", pivots=False))
    return f.select("series_key", "date", "revenue", *LAG_COLS)


@register("ewm_feature", feat_sql("segment") + f"""
SELECT series_key, date, revenue, {T.r('ewm_14d')} AS ewm_14d FROM feat""")
def q_ewm_feature(spark, sf):
    f = _features(spark, sf, "segment", pivots=False)
    return rounded(f.select("series_key", "date", "revenue", "ewm_14d"), {"ewm_14d": 2})


# ---------------------------------------------------------- pivots
def _pivot_sql(by, values):
    cols = ", ".join(
        f"coalesce({T.r(f'sum(CASE WHEN {by} = {chr(39)}{v}{chr(39)} THEN revenue END)')}, 0.0) AS rev_{v.lower()}"
        for v in values)
    return P + f"\nSELECT 'total' AS series_key, date, {cols} FROM fact WHERE {by} IS NOT NULL GROUP BY date"


@register("pivot_segment", _pivot_sql("segment", TEST_SEGMENTS))
def q_pivot_segment(spark, sf):
    return pivot_revenue(_fact(spark, sf), "segment", segment_values(spark, sf))


@register("pivot_category", _pivot_sql("category", TEST_CATEGORIES))
def q_pivot_category(spark, sf):
    return pivot_revenue(_fact(spark, sf), "category", category_values(spark, sf))


@register("daily_features", feat_sql(None, PIVOTS_SQL) + f"""
SELECT series_key, date, {', '.join(T.r(c, 2) + ' AS ' + c if c in ROLL_COLS + ['ewm_14d', 'avg_order_value'] else
                                   T.r(c, 4) + ' AS ' + c if c in ['avg_discount', 'avg_quantity'] else
                                   T.r(c, 6) + ' AS ' + c if c in FOURIER else c
                                   for c in ['revenue'] + FEATURE_NUMERIC)}
FROM feat""")
def q_daily_features(spark, sf):
    f = _features(spark, sf)
    spec = {c: 2 for c in ROLL_COLS + ["ewm_14d", "avg_order_value"]}
    spec.update({c: 4 for c in ["avg_discount", "avg_quantity"]})
    spec.update({c: 6 for c in FOURIER})
    return rounded(f.select("series_key", "date", "revenue", *_numeric(f)), spec)


# ---------------------------------------------------------- RFM
@register("customer_rfm", P + f""",
per AS (
  SELECT customer_id, max(date) AS last_purchase, min(date) AS first_purchase,
         count(transaction_id) AS frequency, {T.r('sum(revenue)')} AS monetary, count(revenue) AS nrev
  FROM fact GROUP BY customer_id
)
SELECT p.customer_id, CAST(date_diff('day', p.last_purchase, c.cutoff) AS INTEGER) AS recency_days,
       p.frequency, p.monetary, {T.r('p.monetary / p.nrev')} AS avg_order,
       p.first_purchase, p.last_purchase,
       {T.r('p.monetary / greatest(p.frequency, 1) * ln(1 + p.frequency)')} AS clv_proxy,
       cc.segment, cc.region, cc.account_tier, cc.tenure_days
FROM per p CROSS JOIN (SELECT max(date) AS cutoff FROM fact) c
LEFT JOIN clean_customers cc ON p.customer_id = cc.customer_id""")
def q_customer_rfm(spark, sf):
    customers, _, fact = clean_star(spark, sf)
    return rounded(R.customer_rfm(fact, customers), {"avg_order": 2, "clv_proxy": 2})


# ---------------------------------------------------------- EDA
@register("eda_overview", P + T.daily_cte() + f"""
SELECT count(*) AS total_transactions, {T.r('sum(revenue)')} AS total_revenue,
       count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_id) AS total_products,
       CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS date_range,
       (SELECT {T.r(T.r('sum(revenue)') + ' / count(revenue)')} FROM daily) AS avg_daily_revenue,
       (SELECT {T.r('stddev_samp(revenue)')} FROM daily) AS revenue_std,
       (SELECT {T.r('quantile_cont(revenue, 0.5)')} FROM daily) AS median_daily_revenue
FROM fact""")
def q_eda_overview(spark, sf):
    return R.overview(_fact(spark, sf), _daily(spark, sf))


def _group_sql(by):
    return P + f"""
SELECT {by}, {T.r('sum(revenue)')} AS total, {T.r(T.r('sum(revenue)') + ' / count(revenue)')} AS avg_order,
       count(revenue) AS count
FROM fact WHERE {by} IS NOT NULL GROUP BY {by}"""


@register("eda_by_segment", _group_sql("segment"))
def q_eda_by_segment(spark, sf):
    return R.group_summary(_fact(spark, sf), "segment")


@register("eda_by_category", _group_sql("category"))
def q_eda_by_category(spark, sf):
    return R.group_summary(_fact(spark, sf), "category")


@register("eda_monthly", P + f"""
SELECT strftime(date, '%Y-%m') AS month, {T.r('sum(revenue)')} AS revenue FROM fact GROUP BY 1""")
def q_eda_monthly(spark, sf):
    return R.monthly_revenue(_fact(spark, sf))


@register("eda_dow", P + T.daily_cte() + f"""
SELECT dayname(date) AS dow_name, {T.r(T.r('sum(revenue)') + ' / count(revenue)')} AS avg_revenue
FROM daily GROUP BY 1""")
def q_eda_dow(spark, sf):
    return R.mean_by_day_name(_daily(spark, sf))


@register("eda_month", P + T.daily_cte() + f"""
SELECT CAST(month(date) AS INTEGER) AS month, {T.r(T.r('sum(revenue)') + ' / count(revenue)')} AS avg_revenue
FROM daily GROUP BY 1""")
def q_eda_month(spark, sf):
    return R.mean_by_month(_daily(spark, sf))


@register("eda_discount", P + f"""
SELECT {T.r(T.r('sum(discount_pct)', 4) + ' / count(discount_pct) * 100')} AS avg_discount_pct,
       {T.r('CAST(sum(CASE WHEN discount_pct > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100')}
         AS pct_transactions_discounted,
       {T.r('coalesce(sum(CASE WHEN discount_pct = 0 THEN revenue END), 0.0)')} AS revenue_at_zero_discount,
       {T.r('coalesce(sum(CASE WHEN discount_pct > 0 THEN revenue END), 0.0)')} AS revenue_with_discount
FROM fact""")
def q_eda_discount(spark, sf):
    return R.discount_analysis(_fact(spark, sf))


@register("eda_profit", P + T.daily_cte() + f"""
SELECT (SELECT {T.r(T.r('sum(gp_margin)', 4) + ' / count(gp_margin) * 100')} FROM daily) AS avg_gp_margin_pct,
       (SELECT {T.r('sum(gross_profit)')} FROM fact) AS total_gross_profit,
       (SELECT {T.r(T.r('sum(recurring_share)', 4) + ' / count(recurring_share) * 100')} FROM daily)
         AS recurring_rev_share""")
def q_eda_profit(spark, sf):
    return R.profitability(_fact(spark, sf), _daily(spark, sf))


@register("eda_outliers", P + T.daily_cte() + f""",
q AS (SELECT quantile_cont(revenue, 0.01) AS p01, quantile_cont(revenue, 0.99) AS p99 FROM daily)
SELECT {T.r('q.p01')} AS p1_daily_revenue, {T.r('q.p99')} AS p99_daily_revenue,
       CAST(sum(CASE WHEN d.revenue > q.p99 THEN 1 ELSE 0 END) AS BIGINT) AS days_above_p99,
       CAST(sum(CASE WHEN d.revenue < q.p01 THEN 1 ELSE 0 END) AS BIGINT) AS days_below_p01
FROM daily d, q GROUP BY q.p01, q.p99""")
def q_eda_outliers(spark, sf):
    return R.outliers(_daily(spark, sf))


def _corr_sql(cols):
    parts = []
    for c in cols:
        both = f"({c} IS NOT NULL AND revenue IS NOT NULL)"
        expr = (f"covar_pop(CAST({c} AS DOUBLE), revenue) / nullif(stddev_pop(CASE WHEN {both} THEN "
                f"CAST({c} AS DOUBLE) END) * stddev_pop(CASE WHEN {both} THEN revenue END), 0)")
        parts.append(f"SELECT '{c}' AS feature, {T.r(expr, 4)} AS corr FROM feat")
    return "\nUNION ALL ".join(parts)


@register("eda_corr", feat_sql(None, PIVOTS_SQL) + f""",
c AS ({_corr_sql(FEATURE_NUMERIC)})
SELECT feature, corr FROM c ORDER BY abs(corr) DESC NULLS LAST, feature LIMIT 15""")
def q_eda_corr(spark, sf):
    return R.correlations(_features(spark, sf), "revenue", top=15)


@register("null_profile", feat_sql(None, PIVOTS_SQL) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM feat"
    for c in ["series_key", "date", "revenue"] + FEATURE_NUMERIC))
def q_null_profile(spark, sf):
    return R.null_profile(_features(spark, sf))


# ---------------------------------------------------------- forecasting
from ledgerlight.operators import forecast as FC  # noqa: E402
from ledgerlight.operators.series import holdout_days, holdout_rows, impute_median  # noqa: E402
from ledgerlight.plans.forecasting import HORIZON, SIMPLE, evaluate  # noqa: E402

FSEG = feat_sql("segment") + T.forecast_ctes(HORIZON)
FTOT = feat_sql(None) + T.forecast_ctes(HORIZON)


def _bundle(spark, sf, series="segment"):
    """Forecast evaluation outputs, written once per session as stage tables."""
    from ledgerlight.plans import stages as _st
    return evaluate(_features(spark, sf, series, pivots=False), HORIZON,
                    materialize=lambda name, build: _st.stage(spark, ("bundle", name, sf, series), build),
                    models=[model() for model in SIMPLE])


def _base(spark, sf, series="segment"):
    return drop_warmup(_features(spark, sf, series, pivots=False))


@register("holdout_rows", FSEG + """
SELECT series_key, date, CASE WHEN rn > n - 90 THEN 'holdout' ELSE 'train' END AS split FROM idx""")
def q_holdout_rows(spark, sf):
    return holdout_rows(_base(spark, sf), 90).select("series_key", "date", "split")


@register("holdout_days", FSEG + """
SELECT series_key, date, CASE WHEN date > CAST(last_date - 90 AS DATE) THEN 'holdout' ELSE 'train' END AS split
FROM idx""")
def q_holdout_days(spark, sf):
    return holdout_days(_base(spark, sf), 90).select("series_key", "date", "split")


_FOLD_OUT = """
SELECT series_key, fold,
       CAST(sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
       max(CASE WHEN role = 'train' THEN date END) AS train_end_date,
       min(CASE WHEN role = 'test' THEN date END) AS test_start_date,
       max(CASE WHEN role = 'test' THEN date END) AS test_end_date
FROM assigned GROUP BY series_key, fold"""


@register("cv_folds_expanding", FSEG + """,
folds AS (
  SELECT series_key, CAST(f AS INTEGER) AS fold, (n - 90) - (4 - f) * 60 - 60 AS train_end,
         (n - 90) - (4 - f) * 60 AS test_end
  FROM last_info, range(0, 5) t(f)
),
assigned AS (
  SELECT i.series_key, i.date, f.fold, CASE WHEN i.rn <= f.train_end THEN 'train' ELSE 'test' END AS role
  FROM idx i JOIN folds f ON i.series_key = f.series_key AND i.rn <= f.test_end
  WHERE f.train_end >= 1
)""" + _FOLD_OUT)
def q_cv_folds_expanding(spark, sf):
    base = _base(spark, sf)
    return FC.fold_summary(FC.assign_row_folds(FC.index_rows(base), FC.expanding_folds(base)))


@register("cv_folds_walk", FSEG + """,
folds AS (
  SELECT series_key, CAST(f AS INTEGER) AS fold, 600 + f * 60 AS train_end, 600 + f * 60 + 90 AS test_end
  FROM last_info, range(0, 3) t(f) WHERE 600 + f * 60 + 90 <= n
),
assigned AS (
  SELECT i.series_key, i.date, f.fold, CASE WHEN i.rn <= f.train_end THEN 'train' ELSE 'test' END AS role
  FROM idx i JOIN folds f ON i.series_key = f.series_key AND i.rn <= f.test_end
)""" + _FOLD_OUT)
def q_cv_folds_walk(spark, sf):
    base = _base(spark, sf)
    return FC.fold_summary(FC.assign_row_folds(FC.index_rows(base), FC.walk_forward_folds(base)))


@register("cv_folds_origin", FSEG + """,
bounds AS (SELECT series_key, min(date) AS first_date, max(date) AS last_date FROM idx GROUP BY series_key),
cuts AS (
  SELECT b.series_key, CAST(k AS INTEGER) AS fold,
         CAST(b.last_date - CAST(90 + k * 60 AS INTEGER) AS DATE) AS cutoff
  FROM bounds b, range(0, 1000) t(k)
  WHERE date_diff('day', CAST(b.first_date + 600 AS DATE), CAST(b.last_date - 90 AS DATE)) >= 0
    AND k <= floor(date_diff('day', CAST(b.first_date + 600 AS DATE), CAST(b.last_date - 90 AS DATE)) / 60)
),
assigned AS (
  SELECT i.series_key, i.date, c.fold, CASE WHEN i.date <= c.cutoff THEN 'train' ELSE 'test' END AS role
  FROM idx i JOIN cuts c ON i.series_key = c.series_key AND i.date <= CAST(c.cutoff + 90 AS DATE)
)""" + _FOLD_OUT)
def q_cv_folds_origin(spark, sf):
    base = _base(spark, sf)
    return FC.fold_summary(FC.assign_day_folds(base, FC.origin_cutoffs(base)))


def _holdout_scores() -> list:
    """Holdout scores as they are shown."""
    return [rh(m, 2).alias(f"holdout_{m}") for m in FC.METRICS]


_CV_SQL = FSEG + f""",
folds AS (
  SELECT series_key, CAST(f AS INTEGER) AS fold, (n - 90) - (4 - f) * 60 - 60 AS train_end,
         (n - 90) - (4 - f) * 60 AS test_end
  FROM last_info, range(0, 5) t(f)
),
cvrows AS (
  SELECT i.series_key, f.fold, i.revenue AS y, i.lag_7d, i.roll_mean_28d
  FROM idx i JOIN folds f ON i.series_key = f.series_key AND i.rn <= f.test_end AND i.rn > f.train_end
  WHERE f.train_end >= 1
),
preds AS (
  SELECT series_key, 'seasonal_naive' AS model, fold, y, greatest(lag_7d, 0.0) AS yhat FROM cvrows
  UNION ALL SELECT series_key, 'moving_average', fold, y, greatest(roll_mean_28d, 0.0) FROM cvrows
),
foldm AS (SELECT series_key, model, fold, {T.metrics()} FROM preds GROUP BY series_key, model, fold),
cvs AS ({T.cv('foldm', 'series_key, model')})"""


def _simple_cv(base: DataFrame) -> DataFrame:
    """M13 of the two simple models over the expanding folds."""
    rows = FC.assign_row_folds(FC.index_rows(base), FC.expanding_folds(base)).where(F.col("role") == "test")
    models = F.array(*[F.struct(F.lit(name).alias("model"), FC.floor0(col).alias("yhat"))
                       for name, col in (("seasonal_naive", "lag_7d"), ("moving_average", "roll_mean_28d"))])
    preds = rows.select("series_key", "fold", F.col("revenue").alias("y"), F.inline(models))
    return FC.cv_summary(FC.error_metrics(preds, ["series_key", "model", "fold"]), ["series_key", "model"])


@register("naive_metrics", _CV_SQL + f"""
SELECT m.series_key, {T.shown('m', 'holdout_')}, c.* EXCLUDE (series_key, model)
FROM met m JOIN cvs c ON m.series_key = c.series_key AND m.model = c.model
WHERE m.model = 'seasonal_naive'""")
def q_naive_metrics(spark, sf):
    b = _bundle(spark, sf)
    naive = F.col("model") == "seasonal_naive"
    hold = b.metrics.where(naive).select("series_key", *_holdout_scores())
    return hold.join(_simple_cv(b.base).where(naive).drop("model"), "series_key")


@register("ensemble_weights", FSEG + f"""
SELECT series_key, model, {T.shown(prefix='holdout_')}, {T.r('weight', 4)} AS weight FROM wts""")
def q_ensemble_weights(spark, sf):
    w = _bundle(spark, sf).weights
    return w.select("series_key", "model", *_holdout_scores(), rh("weight", 4).alias("weight"))


@register("ensemble_forecast", FSEG + "\nSELECT * FROM ens")
def q_ensemble_forecast(spark, sf):
    return _bundle(spark, sf).ensemble


@register("ensemble_holdout", FSEG + f"\nSELECT series_key, {T.shown()}, n_eval FROM ens_met")
def q_ensemble_holdout(spark, sf):
    return FC.rounded_metrics(_bundle(spark, sf).ensemble_metrics)


@register("model_winner", FSEG + "\nSELECT * FROM win")
def q_model_winner(spark, sf):
    return _bundle(spark, sf).winner


@register("model_comparison", _CV_SQL + f"""
SELECT x.series_key, x.model, x.holdout_rmse, x.holdout_mae, x.holdout_mape,
       c.cv_rmse_mean, c.cv_rmse_std, c.cv_mae_mean, c.cv_mae_std, x.weight,
       CAST(NULL AS VARCHAR) AS top_features, (x.model = w.winner) AS is_winner
FROM (
  SELECT series_key, model, {T.shown(prefix='holdout_')}, {T.r('weight', 4)} AS weight FROM wts
  UNION ALL
  SELECT series_key, 'ensemble', {T.shown()}, CAST(NULL AS DOUBLE) FROM ens_met
) x JOIN win w ON x.series_key = w.series_key
LEFT JOIN cvs c ON x.series_key = c.series_key AND x.model = c.model""")
def q_model_comparison(spark, sf):
    """Q5 of the two simple models."""
    b = _bundle(spark, sf)
    return S.comparison(b.weights, b.ensemble_metrics, b.winner, _simple_cv(b.base))


@register("future_spine", FSEG + "\nSELECT series_key, date, h FROM spine")
def q_future_spine(spark, sf):
    from ledgerlight.operators.series import future_spine
    base = _base(spark, sf)
    return future_spine(FC.series_counts(base), HORIZON)


@register("conformal_band", FSEG + "\nSELECT series_key, date, h, yhat, yhat_lower, yhat_upper FROM fc_b")
def q_conformal_band(spark, sf):
    return (_bundle(spark, sf).forecasts.where(F.col("model") == "moving_average")
            .select("series_key", "date", "h", "yhat", "yhat_lower", "yhat_upper"))


@register("future_regressors", FSEG + f""",
lastrow AS (SELECT series_key, arg_max(avg_discount, date) AS last_disc FROM idx GROUP BY series_key),
dates AS (
  SELECT series_key, date FROM idx WHERE date > CAST(last_date - 90 AS DATE)
  UNION ALL SELECT series_key, date FROM spine
)
SELECT d.series_key, d.date,
       coalesce(i.is_q4, CAST(month(d.date) >= 10 AS INTEGER)) AS is_q4,
       coalesce(i.near_holiday, 0) AS near_holiday,
       {T.r('coalesce(i.roll_mean_28d, m.m)')} AS roll_mean_28d,
       {T.r('coalesce(i.avg_discount, l.last_disc)', 4)} AS avg_discount
FROM dates d LEFT JOIN lastrow l ON d.series_key = l.series_key
LEFT JOIN m28 m ON d.series_key = m.series_key
LEFT JOIN idx i ON d.series_key = i.series_key AND d.date = i.date""")
def q_future_regressors(spark, sf):
    from ledgerlight.operators.series import future_spine
    base = _base(spark, sf)
    hd = holdout_days(base, 90).where(F.col("split") == "holdout").select("series_key", "date")
    dates = hd.unionByName(future_spine(FC.series_counts(base), HORIZON).select("series_key", "date"))
    out = FC.future_regressors(base, dates)
    return rounded(out, {"roll_mean_28d": 2, "avg_discount": 4})


@register("forecast_head", FSEG + f"""
SELECT series_key, model, date, yhat, yhat_lower, yhat_upper FROM (
  SELECT series_key, model, date, yhat, yhat_lower, yhat_upper,
         row_number() OVER (PARTITION BY series_key, model ORDER BY date) AS rn
  FROM (
    SELECT series_key, model, date, {T.r('yhat')} AS yhat, yhat_lower, yhat_upper FROM fc
    UNION ALL
    SELECT series_key, 'ensemble', date, yhat_ensemble,
           {T.r('coalesce(ensemble_lower, yhat_ensemble * 0.85)')},
           {T.r('coalesce(ensemble_upper, yhat_ensemble * 1.15)')} FROM ens
  )
) WHERE rn <= 30""")
def q_forecast_head(spark, sf):
    """First 30 days of each model's forecast; the ensemble band
    falls back to +-15 % where it is missing."""
    b = _bundle(spark, sf)
    singles = b.forecasts.select("series_key", "model", "date", rh("yhat", 2).alias("yhat"),
                                 "yhat_lower", "yhat_upper")
    ens = b.ensemble.select(
        "series_key", F.lit("ensemble").alias("model"), "date", F.col("yhat_ensemble").alias("yhat"),
        rh(F.coalesce("ensemble_lower", F.col("yhat_ensemble") * 0.85), 2).alias("yhat_lower"),
        rh(F.coalesce("ensemble_upper", F.col("yhat_ensemble") * 1.15), 2).alias("yhat_upper"))
    return FC.head_per_group(singles.unionByName(ens), ["series_key", "model"], 30)


@register("chart_series", FSEG + """
SELECT series_key, date, revenue AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower,
       CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS DOUBLE) AS overlay
FROM idx WHERE rn > n - 30
UNION ALL
SELECT e.series_key, e.date, NULL, e.yhat_ensemble, e.ensemble_lower,
       greatest(e.ensemble_upper, e.yhat_ensemble), a.yhat
FROM ens e LEFT JOIN fc_a a ON e.series_key = a.series_key AND e.date = a.date""")
def q_chart_series(spark, sf):
    """U2 + J14: last 30 actuals and the ensemble forecast as one series, the
    upper band raised to at least the forecast, the naive forecast overlaid."""
    b = _bundle(spark, sf)
    idx = FC.index_rows(b.base).where(F.col("rn") > F.col("n") - 30)
    actual = idx.select("series_key", "date", F.col("revenue").alias("actual"))
    over = b.forecasts.where(F.col("model") == "seasonal_naive").select(
        "series_key", "date", F.col("yhat").alias("overlay"))
    fc = b.ensemble.join(over, ["series_key", "date"], "left").select(
        "series_key", "date", F.col("yhat_ensemble").alias("forecast"),
        F.col("ensemble_lower").alias("lower"),
        F.greatest("ensemble_upper", "yhat_ensemble").alias("upper"), "overlay")
    return actual.unionByName(fc, allowMissingColumns=True).select(
        "series_key", "date", "actual", "forecast", "lower", "upper", "overlay")


@register("impute_median", FSEG + f""",
meds AS (SELECT series_key, quantile_cont(lag_56d, 0.5) AS m56, quantile_cont(lag_28d, 0.5) AS m28
         FROM feat GROUP BY series_key)
SELECT f.series_key, f.date, {T.r('coalesce(f.lag_56d, m.m56)')} AS lag_56d,
       {T.r('coalesce(f.lag_28d, m.m28)')} AS lag_28d
FROM feat f JOIN meds m ON f.series_key = m.series_key""")
def q_impute_median(spark, sf):
    f = _features(spark, sf, "segment", pivots=False).select("series_key", "date", "lag_56d", "lag_28d")
    return rounded(impute_median(f, ["lag_56d", "lag_28d"]), {"lag_56d": 2, "lag_28d": 2})


# ---------------------------------------------------------- served
from ledgerlight.plans import served as S  # noqa: E402


#: The range that the queries with a range ask for, within the driver's tables.
RANGE = (dt.date(1997, 3, 15), dt.date(1998, 9, 2))
IN_RANGE = "date BETWEEN DATE '1997-03-15' AND DATE '1998-09-02'"


def _actuals_sql(gran: str, where: str = "date BETWEEN b.s AND b.e") -> str:
    if gran == "daily":
        agg = "SELECT date, revenue AS value FROM f"
    else:
        unit = "week" if gran == "weekly" else "month"
        agg = f"SELECT CAST(date_trunc('{unit}', date) AS DATE) AS date, {T.r('sum(revenue)')} AS value FROM f GROUP BY 1"
    return P + T.daily_cte() + f""",
b AS (SELECT CAST(max(date) - 180 AS DATE) AS s, max(date) AS e FROM daily),
f AS (SELECT d.date, d.revenue FROM daily d, b WHERE {where}),
agg AS ({agg})
SELECT a.date, a.value, s.total, s.mean, s.std
FROM agg a, (SELECT {T.r('sum(value)')} AS total, {T.r(T.r('sum(value)') + ' / count(value)')} AS mean,
                    {T.r('stddev_samp(value)')} AS std FROM agg) s"""


for _g in S.GRANULARITIES:
    def _mk(g):
        def q(spark, sf):
            return S.actuals(_daily(spark, sf), g)
        return q
    register(f"actuals_{_g}", _actuals_sql(_g))(_mk(_g))


@register("actuals_range", _actuals_sql("weekly", IN_RANGE))
def q_actuals_range(spark, sf):
    """Q1 with start and end, weekly, from the months of the fact that they cover."""
    return S.fact_actuals(_fact(spark, sf), "weekly", *RANGE)


_TOT_FACT_STATS = f"""
  (SELECT count(DISTINCT customer_id) FROM fact) AS n_customers,
  (SELECT count(DISTINCT product_id) FROM fact) AS n_products,
  (SELECT count(*) FROM fact) AS n_transactions"""


@register("kpis", FTOT + f"""
SELECT {T.r('sum(revenue)')} AS total_revenue,
       {T.r(T.r('sum(revenue)') + ' / count(revenue)')} AS avg_daily_revenue,
       {T.r('stddev_samp(revenue)')} AS revenue_std,
       {T.r(T.r('sum(gp_margin)', 4) + ' / count(gp_margin) * 100')} AS gp_margin_pct,
       {T.r(T.r('sum(recurring_share)', 4) + ' / count(recurring_share) * 100')} AS recurring_share_pct,
       {T.r('avg(avg_discount) * 100')} AS discount_rate_pct,
       min(date) AS date_range_start, max(date) AS date_range_end,
       {_TOT_FACT_STATS},
       (SELECT {T.r('coalesce(sum(yhat_ensemble), 0.0)')} FROM ens) AS forecast_revenue_90d
FROM daily""")
def q_kpis(spark, sf):
    b = _bundle(spark, sf, None)
    return S.kpis(_daily(spark, sf), _fact(spark, sf), b.ensemble)


def _share_sql(by: str, where: str = "true", total: str = "") -> str:
    return P + f""",
g AS (SELECT {by}, {T.r('sum(revenue)')} AS revenue, count(*) AS n_transactions
      FROM fact WHERE {by} IS NOT NULL AND {where} GROUP BY {by})
SELECT {by}, revenue, n_transactions, {T.r('revenue / (SELECT ' + T.r('sum(revenue)') + ' FROM g) * 100')} AS share_pct
       {total and f", (SELECT {T.r('sum(revenue)')} FROM g) AS {total}"}
FROM g"""


@register("segments", _share_sql("segment", total="total_revenue"))
def q_segments(spark, sf):
    return S.segments(_fact(spark, sf))


@register("segments_range", _share_sql("segment", IN_RANGE, "total_revenue"))
def q_segments_range(spark, sf):
    """Q3 with start and end; the fact's other months are not read."""
    return S.segments(_fact(spark, sf), *RANGE)


@register("category_share", _share_sql("category"))
def q_category_share(spark, sf):
    return R.share_of_total(_fact(spark, sf), "category")


@register("freshness", P + "\nSELECT count(*) AS n_rows, max(date) AS last_date FROM fact")
def q_freshness(spark, sf):
    return S.freshness(_fact(spark, sf))


_MONTHLY_SQL = P + f""",
mon AS (SELECT strftime(date, '%Y-%m') AS month, {T.r('sum(revenue)')} AS revenue FROM fact GROUP BY 1)"""


@register("best_worst_month", _MONTHLY_SQL + """
SELECT month, revenue,
       CASE WHEN revenue = (SELECT max(revenue) FROM mon) THEN 'best'
            WHEN revenue = (SELECT min(revenue) FROM mon) THEN 'worst' ELSE '' END AS marker
FROM mon""")
def q_best_worst_month(spark, sf):
    return R.best_worst(R.monthly_revenue(_fact(spark, sf)), "revenue", "month")


def _money_short_sql(v: str) -> str:
    return (f"CASE WHEN {v} >= 1000000 THEN printf('$%.2fM', {T.r(v + ' / 1000000', 2)}) "
            f"WHEN {v} >= 1000 THEN printf('$%.1fk', {T.r(v + ' / 1000', 1)}) "
            f"ELSE printf('$%.0f', {T.r(v, 0)}) END")


@register("money_format", _MONTHLY_SQL + f"""
SELECT month, revenue, {_money_short_sql('revenue')} AS revenue_label,
       strftime(CAST(month || '-01' AS DATE), '%b %y') AS month_label
FROM mon""")
def q_money_format(spark, sf):
    return S.month_labels(R.monthly_revenue(_fact(spark, sf)))


@register("segment_exposure", FTOT + f""",
g AS (SELECT segment, {T.r('sum(revenue)')} AS revenue FROM fact WHERE segment IS NOT NULL GROUP BY segment),
sh AS (SELECT segment, {T.r('revenue / (SELECT ' + T.r('sum(revenue)') + ' FROM g) * 100')} AS share_pct FROM g),
tot AS (SELECT {T.r('sum(yhat_ensemble)')} AS forecast_total FROM ens)
SELECT segment, share_pct, forecast_total, {T.r('forecast_total * share_pct / 100')} AS projected,
       {_money_short_sql(T.r('forecast_total * share_pct / 100'))} AS projected_label
FROM sh, tot""")
def q_segment_exposure(spark, sf):
    return S.segment_exposure(_fact(spark, sf), _bundle(spark, sf, None).ensemble)


def _whole_sql(v: str) -> str:
    return f"'$' || format('{{:,}}', CAST({T.r(v, 0)} AS BIGINT))"


@register("insights", FTOT + f""",
lastd AS (SELECT max(date) AS l FROM daily),
st AS (
  SELECT
    (SELECT {T.r('sum(revenue)')} / count(revenue) FROM daily, lastd WHERE date >= CAST(l - 30 AS DATE)) AS recent_mean,
    (SELECT {T.r('sum(revenue)')} / count(revenue) FROM daily, lastd
      WHERE date >= CAST(l - 60 AS DATE) AND date < CAST(l - 30 AS DATE)) AS prior_mean,
    (SELECT avg(avg_discount) FROM daily, lastd WHERE date >= CAST(l - 30 AS DATE)) AS recent_disc,
    (SELECT {T.r('sum(revenue)')} / count(revenue) FROM daily WHERE isodow(date) - 1 < 5) AS weekday_mean,
    (SELECT {T.r('sum(revenue)')} / count(revenue) FROM daily WHERE isodow(date) - 1 >= 5) AS weekend_mean,
    (SELECT {T.r('sum(revenue)')} / count(revenue) FROM
       (SELECT revenue FROM daily ORDER BY date DESC LIMIT 30)) AS actual_mean,
    (SELECT {T.r('sum(yhat_ensemble)')} / count(yhat_ensemble) FROM ens) AS forecast_mean,
    (SELECT l FROM lastd) AS last_date
),
calc AS (
  SELECT *, (recent_mean - prior_mean) / prior_mean * 100 AS pct,
         (forecast_mean - actual_mean) / actual_mean * 100 AS uplift,
         CASE WHEN weekend_mean IS NOT NULL THEN weekday_mean / greatest(weekend_mean, 1.0) END AS ratio
  FROM st
)
SELECT CASE WHEN pct > 0 THEN 'trend' ELSE 'risk' END AS type,
       printf('Revenue trending %s %.1f%%', CASE WHEN pct > 0 THEN 'up' ELSE 'down' END, {T.r('abs(pct)', 1)}) AS title,
       'Average daily revenue over the last 30 days is ' || {_whole_sql('recent_mean')} || ', compared to '
         || {_whole_sql('prior_mean')} || ' in the prior 30-day period.' AS detail,
       'revenue_30d_change_pct' AS metric, {T.r('pct')} AS value
FROM calc WHERE recent_mean IS NOT NULL AND prior_mean IS NOT NULL
UNION ALL
SELECT 'risk', printf('High discount intensity: %.1f%%', {T.r('recent_disc * 100', 1)}),
       'Average transaction discount over the last 30 days exceeds 15%. Heavy discounting may be compressing gross profit margin.',
       'avg_discount_30d', {T.r('recent_disc * 100')} FROM calc WHERE recent_disc > 0.15
UNION ALL
SELECT CASE WHEN uplift > 0 THEN 'opportunity' ELSE 'risk' END,
       printf('90-day forecast %s recent run-rate', CASE WHEN uplift > 0 THEN 'above' ELSE 'below' END),
       'The ensemble model projects average daily revenue of ' || {_whole_sql('forecast_mean')}
         || ' over the next 90 days, ' || CASE WHEN uplift > 0 THEN 'up ' ELSE 'down ' END
         || printf('%.1f', {T.r('abs(uplift)', 1)}) || '% from the recent 30-day average of '
         || {_whole_sql('actual_mean')} || '.',
       'forecast_vs_actuals_pct', {T.r('uplift')} FROM calc WHERE forecast_mean IS NOT NULL
UNION ALL
SELECT 'info', printf('Weekday revenue %.1f× higher than weekends', {T.r('ratio', 1)}),
       'Average weekday revenue is ' || {_whole_sql('weekday_mean')} || ' vs ' || {_whole_sql('coalesce(weekend_mean, 0)')}
         || ' on weekends. Campaign scheduling should prioritise weekdays.',
       'weekday_weekend_ratio', {T.r('ratio')} FROM calc WHERE ratio > 1.5
UNION ALL
SELECT 'opportunity', 'Q4 seasonal uplift approaching',
       'Historical data shows consistent Q4 uplift (Oct–Dec). Consider increasing inventory and marketing spend ahead of the peak period.',
       CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE)
FROM calc WHERE month(last_date) IN (8, 9)""")
def q_insights(spark, sf):
    return S.insights(_daily(spark, sf), _bundle(spark, sf, None).ensemble)


# ---------------------------------------------------------- MLlib models (M1, M3, M4, M6, M7; rows-only)
from ledgerlight.operators import ridge as RG  # noqa: E402
from ledgerlight.operators import trees as TR  # noqa: E402

_MODELS: dict = {}


#: Rounds, rate and patience of the queries' models.
BOOSTING = TR.Boosting(rounds=40, rate=0.1, patience=8)


def _vectors(spark, sf):
    """The segment series with their feature vectors, written once for all fits."""
    from ledgerlight.plans import stages as _st
    return _st.stage(spark, ("vectors", sf), lambda: TR.with_vectors(_base(spark, sf)).select(
        "series_key", "date", "revenue", "features"))


def _tree(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = TR.holdout_eval(_vectors(spark, sf), settings=BOOSTING)
    return _MODELS[key]


@register("tree_holdout")
def q_tree_holdout(spark, sf):
    """M1: one GBT over all segment series, scored on each series' last 90 rows."""
    return FC.rounded_metrics(_tree(spark, sf)[2])


@register("saved_model_holdout")
def q_saved_model_holdout(spark, sf):
    """The trees saved, loaded and scored again on each series' last 90 rows."""
    from ledgerlight.plans import stages as _st
    model = load_gbt_model(_st.folder(spark, ("saved_model", sf), lambda to: save_model(_tree(spark, sf)[0], to)))
    rows = holdout_rows(_vectors(spark, sf), 90).where(F.col("split") == "holdout")
    pred = model.transform(rows).select("series_key", F.col("revenue").alias("y"), FC.floor0("prediction").alias("yhat"))
    return FC.rounded_metrics(FC.error_metrics(pred, ["series_key"]))


@register("tree_importance")
def q_tree_importance(spark, sf):
    """Feature importances, top 20, relative to the top one."""
    return TR.importance(spark, _tree(spark, sf)[0])


@register("tree_forecast")
def q_tree_forecast(spark, sf):
    """Recursive forecast, every series in parallel, 90 steps."""
    from ledgerlight.sources.holidays import us_holidays, years_spanned
    base = _base(spark, sf)
    hol = us_holidays(years_spanned(base, pad=1))
    return TR.recursive_forecast(spark, _tree(spark, sf)[0], base, hol, HORIZON)


def _gram_sql() -> str:
    names = ["one", *RG.REGRESSORS, "resid"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return FSEG + """,
g AS (
  SELECT series_key, 1.0 AS one, CAST(is_q4 AS DOUBLE) AS is_q4, CAST(near_holiday AS DOUBLE) AS near_holiday,
         roll_mean_28d, avg_discount, revenue - greatest(roll_mean_28d, 0.0) AS resid
  FROM idx
)""" + "\nUNION ALL ".join(
        f"SELECT series_key, '{a}' AS factor_a, '{b}' AS factor_b, printf('%.6e', sum({a} * {b})) AS value "
        f"FROM g GROUP BY series_key" for a, b in pairs)


def _ma_fitted(base: DataFrame) -> DataFrame:
    """The moving average's in-sample fit with the regressors of its days."""
    return FC.moving_average_in_sample(base).join(
        base.select("series_key", "date", *RG.REGRESSORS), ["series_key", "date"])


@register("ridge_gram", _gram_sql())
def q_ridge_gram(spark, sf):
    """The sums that the residual ridge is solved from, to seven digits."""
    sums = RG.named_sums(RG.residual_sums(_ma_fitted(_base(spark, sf))))
    return sums.withColumn("value", F.format_string("%.6e", "value"))


@register("ridge_lift")
def q_ridge_lift(spark, sf):
    """Ridge (alpha 1) of the moving-average model's in-sample
    residuals on the four regressors, applied to its future forecast."""
    from ledgerlight.operators.series import future_spine
    base = _base(spark, sf)
    coefs = RG.fit_residual_ridge(_ma_fitted(base))
    fc = FC.last_n_mean_future(base, HORIZON)
    dates = future_spine(FC.series_counts(base), HORIZON).select("series_key", "date")
    regs = FC.future_regressors(base, dates)
    out = RG.apply_correction(fc, regs, coefs)
    return out.select("series_key", "date", "h", rh("yhat", 2).alias("yhat"))


# ---------------------------------------------------------- seasonal decomposition
from ledgerlight.operators.decompose import seasonal_forecast, walk_forward_scores  # noqa: E402


def _decomp_sql(periods=(7, 365), idx: str = "idx", spine: str = "spine", last: str = "last_info") -> tuple[str, str]:
    """CTEs, and the query of the forecast, of the series in ``idx``, ``spine`` and ``last``."""
    parts = [f""",
dd0 AS (SELECT series_key, date, revenue AS d, date_diff('day', DATE '1970-01-01', date) AS pos, n FROM {idx})"""]
    prev = "dd0"
    for p in periods:
        half = (p - 1) // 2
        w = f"(PARTITION BY series_key ORDER BY date ROWS BETWEEN {half} PRECEDING AND {p - 1 - half} FOLLOWING)"
        parts.append(f""",
tr{p} AS (
  SELECT *, CASE WHEN count(d) OVER {w} = {p}
                 THEN {T.r(f'sum(d) OVER {w}')} / count(d) OVER {w} END AS tr
  FROM {prev}
),
raw{p} AS (
  SELECT series_key, pos % {p} AS slot, {T.r('sum(d - tr)')} / count(d) AS raw
  FROM tr{p} WHERE tr IS NOT NULL AND n >= {2 * p} GROUP BY series_key, pos % {p}
),
ix{p} AS (SELECT series_key, slot, raw - avg(raw) OVER (PARTITION BY series_key) AS s FROM raw{p}),
ds{p} AS (
  SELECT t.series_key, t.date, t.d - coalesce(i.s, 0.0) AS d, t.pos, t.n
  FROM tr{p} t LEFT JOIN ix{p} i ON t.series_key = i.series_key AND t.pos % {p} = i.slot
)""")
        prev = f"ds{p}"
    adds = " + ".join(f"coalesce(i{p}.s, 0.0)" for p in periods)
    joins = "\n".join(
        f"LEFT JOIN ix{p} i{p} ON sp.series_key = i{p}.series_key "
        f"AND date_diff('day', DATE '1970-01-01', sp.date) % {p} = i{p}.slot" for p in periods)
    parts.append(f""",
tailr AS (
  SELECT x.series_key, x.d, CAST(date_diff('day', l.last_date, x.date) AS DOUBLE) AS xo
  FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date DESC) AS rnd FROM {prev}) x
  JOIN {last} l ON x.series_key = l.series_key WHERE x.rnd <= 90
),
line AS (SELECT series_key, regr_slope(d, xo) AS slope, regr_intercept(d, xo) AS icpt FROM tailr GROUP BY series_key)""")
    return "".join(parts), f"""
SELECT sp.series_key, sp.date, sp.h,
       {T.r(f'greatest(coalesce(ln.icpt, 0.0) + coalesce(ln.slope, 0.0) * sp.h + {adds}, 0.0)')} AS yhat
FROM {spine} sp JOIN line ln ON sp.series_key = ln.series_key
{joins}"""


@register("seasonal_forecast", FSEG + "".join(_decomp_sql()))
def q_seasonal_forecast(spark, sf):
    return seasonal_forecast(_base(spark, sf), HORIZON)


_WALK_SQL = FSEG + """,
folds AS (
  SELECT series_key, CAST(f AS INTEGER) AS fold, 600 + f * 60 AS train_end, 600 + f * 60 + 90 AS test_end
  FROM last_info, range(0, 3) t(f) WHERE 600 + f * 60 + 90 <= n
),
fidx AS (
  SELECT i.series_key || '#' || f.fold AS series_key, i.date, i.revenue,
         count(*) OVER (PARTITION BY i.series_key, f.fold) AS n
  FROM idx i JOIN folds f ON i.series_key = f.series_key AND i.rn <= f.train_end
),
flast AS (SELECT series_key, max(date) AS last_date FROM fidx GROUP BY series_key),
fspine AS (
  SELECT series_key, CAST(last_date + CAST(t.h AS INTEGER) AS DATE) AS date, CAST(t.h AS INTEGER) AS h
  FROM flast, range(1, 91) t(h)
)""" + "{},\nffc AS ({})".format(*_decomp_sql(idx="fidx", spine="fspine", last="flast")) + f""",
ftest AS (
  SELECT i.series_key, f.fold, CAST(i.rn - f.train_end AS INTEGER) AS h, i.revenue AS y
  FROM idx i JOIN folds f ON i.series_key = f.series_key AND i.rn > f.train_end AND i.rn <= f.test_end
),
foldm AS (
  SELECT t.series_key, t.fold, {T.metrics('t.y', 'c.yhat')}
  FROM ftest t JOIN ffc c ON c.series_key = t.series_key || '#' || t.fold AND c.h = t.h
  GROUP BY t.series_key, t.fold
)"""


@register("decomposition_cv", _WALK_SQL + f"\nSELECT series_key, fold, {T.shown()}, n_eval FROM foldm")
def q_decomposition_cv(spark, sf):
    """M9: scores of the decomposition in each walk-forward fold."""
    return FC.rounded_metrics(walk_forward_scores(_base(spark, sf)))


@register("decomposition_cv_summary", _WALK_SQL + T.cv("foldm"))
def q_decomposition_cv_summary(spark, sf):
    """M13 of M9."""
    return FC.cv_summary(walk_forward_scores(_base(spark, sf)), ["series_key"])


# ---------------------------------------------------------- long-form EDA report (Q7)
_OV = ["total_transactions", "total_revenue", "total_customers", "total_products",
       "avg_daily_revenue", "median_daily_revenue", "revenue_std"]
_DISC = ["avg_discount_pct", "pct_transactions_discounted", "revenue_at_zero_discount", "revenue_with_discount"]
_PROF = ["avg_gp_margin_pct", "total_gross_profit", "recurring_rev_share"]
_OUT = ["p1_daily_revenue", "p99_daily_revenue", "days_above_p99", "days_below_p01"]


def _body(name: str, prefix: str) -> str:
    sql = ORACLE[name]
    assert sql.startswith(prefix), name
    return sql[len(prefix):]


def _eda_report_sql() -> str:
    pre = feat_sql(None, PIVOTS_SQL)
    pd_ = P + T.daily_cte()
    ctes = {
        "ov": _body("eda_overview", pd_), "seg": _body("eda_by_segment", P), "cat": _body("eda_by_category", P),
        "mon": _body("eda_monthly", P), "dow": _body("eda_dow", pd_), "moy": _body("eda_month", pd_),
        "disc": _body("eda_discount", P), "prof": _body("eda_profit", pd_),
    }
    out = pre + ",\n" + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + f""",
qq AS (SELECT quantile_cont(revenue, 0.01) AS p01, quantile_cont(revenue, 0.99) AS p99 FROM daily),
outl AS (
  SELECT {T.r('qq.p01')} AS p1_daily_revenue, {T.r('qq.p99')} AS p99_daily_revenue,
         CAST(sum(CASE WHEN d.revenue > qq.p99 THEN 1 ELSE 0 END) AS BIGINT) AS days_above_p99,
         CAST(sum(CASE WHEN d.revenue < qq.p01 THEN 1 ELSE 0 END) AS BIGINT) AS days_below_p01
  FROM daily d, qq GROUP BY qq.p01, qq.p99
),
cc AS ({_corr_sql(FEATURE_NUMERIC)}),
corr15 AS (SELECT feature, corr FROM cc ORDER BY abs(corr) DESC NULLS LAST, feature LIMIT 15)
"""
    branches = []

    def add(src, section, metrics, key=None):
        k = f"CAST({key} AS VARCHAR)" if key else "''"
        for m in metrics:
            value, text = ("NULL", m) if m == "date_range" else (m, "NULL")
            branches.append(f"SELECT '{section}' AS section, {k} AS key, '{m}' AS metric, "
                            f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text FROM {src}")
    add("ov", "overview", [*_OV, "date_range"])
    add("seg", "by_segment", ["total", "avg_order", "count"], "segment")
    add("cat", "by_category", ["total", "avg_order", "count"], "category")
    add("mon", "monthly_revenue", ["revenue"], "month")
    add("dow", "avg_revenue_by_dow", ["avg_revenue"], "dow_name")
    add("moy", "avg_revenue_by_month", ["avg_revenue"], "month")
    add("disc", "discount_analysis", _DISC)
    add("prof", "profitability", _PROF)
    add("corr15", "top_correlated_features", ["corr"], "feature")
    add("outl", "outliers", _OUT)
    return out + "\nUNION ALL ".join(branches)


@register("eda_report", _eda_report_sql())
def q_eda_report(spark, sf):
    feats = _features(spark, sf)
    return R.eda_report(_fact(spark, sf), feats, R.numeric_columns(feats, exclude=["revenue"]))


@register("report_json", ORACLE["eda_report"])
def q_report_json(spark, sf):
    """The report written as JSON lines, and read back."""
    from ledgerlight.plans import stages as _st
    return read_report_json(spark, _st.folder(
        spark, ("report_json", sf), lambda to: write_report_json(q_eda_report(spark, sf), to)))


@register("metrics_json", ORACLE["ensemble_weights"])
def q_metrics_json(spark, sf):
    """The models' scores and weights from their JSON file."""
    from ledgerlight.plans import stages as _st
    return read_metrics_json(spark, _st.folder(
        spark, ("metrics_json", sf), lambda to: write_report_json(q_ensemble_weights(spark, sf), to)))


# ---------------------------------------------------------- forecast summary
@register("forecast_summary", FSEG + f"""
SELECT series_key, model, count(*) AS days,
       {T.r(T.r('sum(yhat)') + ' / count(yhat)')} AS mean, min(yhat) AS min, max(yhat) AS max
FROM (SELECT series_key, model, {T.r('yhat')} AS yhat FROM fc
      UNION ALL SELECT series_key, 'ensemble', yhat_ensemble FROM ens)
GROUP BY series_key, model""")
def q_forecast_summary(spark, sf):
    from ledgerlight.operators.ensemble import forecast_summary
    b = _bundle(spark, sf)
    fc = b.forecasts.select("series_key", "model", rh("yhat", 2).alias("yhat")).unionByName(
        b.ensemble.select("series_key", F.lit("ensemble").alias("model"), F.col("yhat_ensemble").alias("yhat")))
    return forecast_summary(fc)


# ---------------------------------------------------------- additive model (M10; rows-only)
from ledgerlight.operators import additive as AD  # noqa: E402


def _holidays_for(df):
    from ledgerlight.sources.holidays import us_holidays, years_spanned
    return us_holidays(years_spanned(df, pad=1))


@register("additive_holdout")
def q_additive_holdout(spark, sf):
    """M10 scored on each series' last 90 days (fit on the days before)."""
    base = _base(spark, sf)
    hol = _holidays_for(base)
    split = holdout_days(base, 90)
    test = split.where(F.col("split") == "holdout")
    pred = AD.fit_predict(split.where(F.col("split") == "train"),
                          test.select("series_key", "date", *RG.REGRESSORS), hol)
    scored = pred.join(test.select("series_key", "date", F.col("revenue").alias("y")), ["series_key", "date"])
    return FC.rounded_metrics(FC.error_metrics(scored, ["series_key"]))


@register("additive_forecast")
def q_additive_forecast(spark, sf):
    """M10 refitted on all rows, 90 days ahead with assumed regressors."""
    from ledgerlight.operators.series import future_spine
    base = _base(spark, sf)
    hol = _holidays_for(base)
    dates = future_spine(FC.series_counts(base), HORIZON).select("series_key", "date")
    regs = FC.future_regressors(base, dates)
    return AD.fit_predict(base, regs, hol)


@register("additive_cv")
def q_additive_cv(spark, sf):
    """Scores of the additive model after every cutoff."""
    base = _base(spark, sf)
    return FC.rounded_metrics(AD.rolling_origin_scores(base, _holidays_for(base)))


@register("additive_cv_summary")
def q_additive_cv_summary(spark, sf):
    """M13 of M11."""
    base = _base(spark, sf)
    return FC.cv_summary(AD.rolling_origin_scores(base, _holidays_for(base)), ["series_key"])


@register("tree_cv")
def q_tree_cv(spark, sf):
    """M2 + M13: expanding-window CV of the boosted trees (5 folds x 60 rows
    of the training part), mean and population std of fold scores."""
    return _tree_cv(spark, sf)


def _tree_cv(spark, sf):
    from ledgerlight.plans import stages as _st

    def scores():
        base = _vectors(spark, sf)
        return TR.cv_scores(base, FC.expanding_folds(base), settings=BOOSTING)
    return FC.cv_summary(_st.stage(spark, ("tree_cv", sf), scores), ["series_key"])


@register("feature_summary", feat_sql(None, PIVOTS_SQL) + f"""
SELECT count(*) AS n_rows, {2 + 1 + len(FEATURE_NUMERIC)} AS n_columns, min(date) AS first_date,
       max(date) AS last_date, min(revenue) AS min_value, max(revenue) AS max_value FROM feat""")
def q_feature_summary(spark, sf):
    """Shape and ranges of the daily feature table."""
    f = _features(spark, sf)
    return R.frame_summary(f.select("series_key", "date", "revenue", *_numeric(f)))


# ---------------------------------------------------------- the real models served (M20, Q2, Q4-Q6, Q8; rows-only)
from ledgerlight.plans.forecasting import MODELS as REAL_MODELS, BoostedTrees, CorrectedDecomposition  # noqa: E402


def _real_bundle(spark, sf):
    """Boosted trees and corrected decomposition per segment, written once per session."""
    from ledgerlight.plans import stages as _st
    return evaluate(_features(spark, sf, "segment", pivots=False), HORIZON,
                    materialize=lambda name, build: _st.stage(spark, ("real", name, sf), build),
                    models=[BoostedTrees(evaluated=lambda: _tree(spark, sf)), CorrectedDecomposition()])


def _real_total(spark, sf):
    """The segments' ensembles added up by day: the forecast of the whole business."""
    return _real_bundle(spark, sf).ensemble.groupBy("date").agg(
        rh(F.sum("yhat_ensemble"), 2).alias("yhat_ensemble"))


@register("real_model_comparison")
def q_real_model_comparison(spark, sf):
    """Q5 of the real models, with their cross-validation and the trees' ten top features."""
    b = _real_bundle(spark, sf)
    cv = _tree_cv(spark, sf).withColumn("model", F.lit(BoostedTrees.name)).unionByName(
        FC.cv_or_holdout(FC.cv_summary(walk_forward_scores(b.base), ["series_key"]),
                         b.metrics.where(F.col("model") == CorrectedDecomposition.name))
        .withColumn("model", F.lit(CorrectedDecomposition.name)))
    top = TR.importance(spark, _tree(spark, sf)[0], top=10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("importance")).alias("i"), "feature"))), lambda x: x["feature"]), ",").alias("top_features"))
    return S.comparison(b.weights, b.ensemble_metrics, b.winner, cv,
                        top.withColumn("model", F.lit(BoostedTrees.name)))


@register("real_forecast")
def q_real_forecast(spark, sf):
    """Q6: 90 days of every real model and of the ensemble, with bands."""
    b = _real_bundle(spark, sf)
    out = None
    for model in ["ensemble", *[m.name for m in REAL_MODELS]]:
        part = S.forecast_points(b.forecasts, b.ensemble, model, HORIZON)
        out = part if out is None else out.unionByName(part)
    return out


@register("real_kpis")
def q_real_kpis(spark, sf):
    return S.kpis(_daily(spark, sf), _fact(spark, sf), _real_total(spark, sf))


@register("real_insights")
def q_real_insights(spark, sf):
    return S.insights(_daily(spark, sf), _real_total(spark, sf))


@register("real_segment_exposure")
def q_real_segment_exposure(spark, sf):
    return S.segment_exposure(_fact(spark, sf), _real_total(spark, sf))
