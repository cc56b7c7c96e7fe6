"""DuckDB twins of the Spark plans, used only as the correctness oracle.

Each function returns SQL text; the CTE chain mirrors the Spark stages step
by step (raw flat table, star schema, cleaning, daily aggregates).  Rounding
is written as ``floor(x * 10^d + 0.5) / 10^d`` in both engines so results
are bit-identical (the engines' ``round`` disagree on some halves).
"""

from __future__ import annotations

import math


def r(expr: str, d: int = 2) -> str:
    s = 10 ** d
    return f"(floor(({expr}) * {s}.0 + 0.5) / {s}.0)"


def pseudo(expr: str) -> str:
    return f"('CUST_' || upper(substr(sha256(CAST({expr} AS VARCHAR)), 1, 10)))"


RAW = """
raw AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number,
         l.l_partkey AS part_key, l.l_suppkey AS supp_key,
         CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_key,
         c.c_name AS customer_name, c.c_mktsegment AS segment, n.n_name AS region,
         CAST(l.l_partkey AS VARCHAR) AS product_key, p.p_type AS category,
         l.l_extendedprice * (1.0 - l.l_discount) AS sales,
         l.l_quantity * p.p_retailprice AS cost,
         l.l_extendedprice * (1.0 - l.l_discount) - l.l_quantity * p.p_retailprice AS profit,
         l.l_discount AS discount, CAST(l.l_quantity AS BIGINT) AS quantity
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def star_ctes(recurring_category: str = "PROMO", min_customers: int = 30) -> str:
    return RAW + f""",
cust_agg AS (
  SELECT customer_key,
         arg_min(segment, (order_key, line_number, part_key, supp_key)) AS segment,
         arg_min(region, (order_key, line_number, part_key, supp_key)) AS region,
         sum(sales) AS lifetime_spend,
         greatest(date_diff('day', min(order_date), max(order_date)), 1) AS tenure_days
  FROM raw GROUP BY customer_key
),
terciles AS (
  SELECT quantile_cont(lifetime_spend, 0.33) AS q33, quantile_cont(lifetime_spend, 0.66) AS q66
  FROM cust_agg
),
customers_k AS (
  SELECT customer_key, {pseudo('customer_key')} AS customer_id, segment, region,
         CAST(tenure_days AS INTEGER) AS tenure_days,
         CASE WHEN lifetime_spend <= q33 THEN 'Bronze'
              WHEN lifetime_spend <= q66 THEN 'Silver' ELSE 'Gold' END AS account_tier,
         lifetime_spend
  FROM cust_agg, terciles
),
customers AS (
  SELECT customer_id, segment, region, tenure_days, account_tier FROM customers_k
),
prod_tx AS (
  SELECT product_key, category, order_key, line_number, part_key, supp_key, customer_key,
         sales / greatest(quantity, 1) AS unit_price,
         coalesce(CASE WHEN sales <> 0 THEN profit / sales END, 0.0) AS margin_tx
  FROM raw
),
prod_agg AS (
  SELECT product_key,
         arg_min(category, (order_key, line_number, part_key, supp_key)) AS category,
         count(DISTINCT order_key) AS n_orders,
         count(DISTINCT customer_key) AS unique_customers,
         quantile_cont(unit_price, 0.5) AS med_price,
         quantile_cont(margin_tx, 0.5) AS med_margin
  FROM prod_tx GROUP BY product_key
),
products AS (
  SELECT product_key AS product_id, category,
         {r('med_price', 2)} AS base_price,
         {r('least(greatest(med_margin, -0.5), 0.9)', 4)} AS margin_pct,
         (category = '{recurring_category}' OR unique_customers >= {min_customers}) AS is_recurring,
         n_orders, unique_customers
  FROM prod_agg
),
txn AS (
  SELECT concat_ws('_', 'TXN', x.order_key, x.line_number, x.part_key, x.supp_key, x.quantity,
                   CAST(floor(x.sales * 100.0 + 0.5) AS BIGINT)) AS transaction_id,
         x.order_date AS date,
         coalesce(ck.customer_id, {pseudo('x.customer_key')}) AS customer_id,
         x.product_key AS product_id, ck.segment, ck.region, x.category, x.quantity,
         {r('x.sales / greatest(x.quantity, 1)', 2)} AS unit_price,
         {r('x.discount', 4)} AS discount_pct,
         {r('x.sales', 2)} AS revenue,
         {r('x.sales - x.profit', 2)} AS cost,
         {r('x.profit', 2)} AS gross_profit,
         coalesce(pr.is_recurring, false) AS is_recurring,
         ck.account_tier,
         x.order_key, x.part_key, x.supp_key
  FROM raw x
  LEFT JOIN products pr ON x.product_key = pr.product_id
  LEFT JOIN customers_k ck ON x.customer_key = ck.customer_key
)"""


DIRTY = """,
txn_in AS (
  SELECT transaction_id, date,
         CASE WHEN order_key % 79 = 0 THEN """ + pseudo("'ORPHAN'") + """ ELSE customer_id END AS customer_id,
         product_id, segment, region, category,
         CASE WHEN order_key % 97 = 0 THEN 'n/a' ELSE CAST(quantity AS VARCHAR) END AS quantity,
         unit_price,
         CASE WHEN order_key % 83 = 0 THEN discount_pct * 10 ELSE discount_pct END AS discount_pct,
         CASE WHEN order_key % 89 = 0 THEN -revenue ELSE revenue END AS revenue,
         cost, gross_profit, is_recurring, account_tier, order_key, part_key, supp_key
  FROM (SELECT * FROM txn UNION ALL SELECT * FROM txn WHERE order_key % 71 = 0)
)"""

PLAIN = """,
txn_in AS (SELECT * FROM txn)"""

DEDUP_ORDER = ("part_key, supp_key, date, customer_id, product_id, segment, region, category, "
               "quantity, unit_price, discount_pct, revenue, cost, gross_profit, is_recurring, "
               "account_tier, order_key")


def clean_ctes(dirty: bool = False, cap_q: float = 0.995) -> str:
    order = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in DEDUP_ORDER.split(","))
    return (DIRTY if dirty else PLAIN) + f""",
deduped AS (
  SELECT * FROM txn_in
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY {order}) = 1
),
typed AS (
  SELECT * REPLACE (
    TRY_CAST(quantity AS BIGINT) AS quantity,
    TRY_CAST(revenue AS DOUBLE) AS revenue,
    TRY_CAST(unit_price AS DOUBLE) AS unit_price,
    TRY_CAST(discount_pct AS DOUBLE) AS discount_pct,
    TRY_CAST(gross_profit AS DOUBLE) AS gross_profit)
  FROM deduped
),
positive AS (SELECT * FROM typed WHERE revenue IS NULL OR revenue > 0),
caps AS (
  SELECT category, {r(f'quantile_cont(revenue, {cap_q})')} AS revenue_cap
  FROM positive WHERE category IS NOT NULL AND revenue IS NOT NULL GROUP BY category
),
capped AS (
  SELECT p.* REPLACE (CASE WHEN p.revenue IS NOT NULL
                           THEN least(p.revenue, coalesce(c.revenue_cap, CAST('inf' AS DOUBLE))) END AS revenue)
  FROM positive p LEFT JOIN caps c ON p.category = c.category
),
non_null AS (
  SELECT * FROM capped
  WHERE date IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL AND revenue IS NOT NULL
),
final AS (
  SELECT * REPLACE (
    CASE WHEN discount_pct IS NOT NULL THEN least(greatest(discount_pct, 0.0), 0.5) END AS discount_pct,
    CASE WHEN quantity IS NOT NULL THEN greatest(quantity, 1) END AS quantity,
    {r('revenue - cost', 2)} AS gross_profit)
  FROM non_null
),
clean_customers AS (
  SELECT customer_id, trim(segment) AS segment, trim(region) AS region,
         greatest(tenure_days, 0) AS tenure_days, account_tier
  FROM customers
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY segment NULLS FIRST, region NULLS FIRST,
                             tenure_days NULLS FIRST, account_tier NULLS FIRST) = 1
),
clean_products AS (
  SELECT product_id, category, greatest(base_price, 0.01) AS base_price,
         least(greatest(margin_pct, 0.0), 1.0) AS margin_pct, is_recurring
  FROM products
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY category NULLS FIRST,
                             base_price NULLS FIRST, margin_pct NULLS FIRST, is_recurring NULLS FIRST) = 1
),
fact AS (
  SELECT * FROM final
  WHERE customer_id IN (SELECT customer_id FROM clean_customers)
    AND product_id IN (SELECT product_id FROM clean_products)
)"""


def fact_prefix(dirty: bool = False, recurring_category: str = "PROMO", min_customers: int = 30) -> str:
    """``WITH raw, ..., fact`` where ``fact`` is the cleaned transaction fact."""
    return "WITH " + star_ctes(recurring_category, min_customers) + clean_ctes(dirty)


def daily_cte(series: str | None = None, pivots: dict | None = None, src: str = "fact",
              name: str = "daily") -> str:
    key = "'total'" if series is None else f"CAST({series} AS VARCHAR)"
    where = "" if series is None else f"WHERE {series} IS NOT NULL"
    piv = ""
    for by, values in (pivots or {}).items():
        for v in values:
            piv += (f",\n         coalesce({r(f"sum(CASE WHEN {by} = '{v}' THEN revenue END)")}, 0.0)"
                    f" AS \"rev_{v.lower()}\"")
    return f""",
{name}_agg AS (
  SELECT {key} AS series_key, date,
         {r('sum(revenue)')} AS revenue, {r('sum(gross_profit)')} AS gross_profit,
         count(transaction_id) AS n_transactions,
         count(DISTINCT customer_id) AS n_customers, count(DISTINCT product_id) AS n_products,
         {r('sum(revenue)')} / count(revenue) AS avg_order_value,
         {r('sum(discount_pct)', 4)} / count(discount_pct) AS avg_discount,
         avg(quantity) AS avg_quantity,
         {r('sum(CASE WHEN is_recurring THEN revenue ELSE 0.0 END)')} AS recurring_rev{piv}
  FROM {src} {where}
  GROUP BY 1, 2
),
{name} AS (
  SELECT *,
         {r('CASE WHEN revenue <> 0 THEN gross_profit / revenue END', 4)} AS gp_margin,
         {r('CASE WHEN revenue <> 0 THEN recurring_rev / revenue END', 4)} AS recurring_share,
         {r('CASE WHEN n_customers <> 0 THEN revenue / n_customers END', 2)} AS rev_per_customer
  FROM {name}_agg
)"""


TWO_PI = repr(2.0 * math.pi)

US_RULES_SQL = [
    ("New Year", "make_date(y, 1, 1)"),
    ("MLK Day", "{nth(1, 0, 3)}"),
    ("Presidents Day", "{nth(2, 0, 3)}"),
    ("Memorial Day", "{last(5, 0)}"),
    ("Independence Day", "make_date(y, 7, 4)"),
    ("Labor Day", "{nth(9, 0, 1)}"),
    ("Thanksgiving", "{nth(11, 3, 4)}"),
    ("Black Friday", "{nth(11, 3, 4)} + 1"),
    ("Cyber Monday", "{nth(11, 3, 4)} + 4"),
    ("Christmas", "make_date(y, 12, 25)"),
]


def _nth(m: int, wd: int, n: int) -> str:
    f = f"make_date(y, {m}, 1)"
    return f"(CAST({f} AS DATE) + CAST((({wd} - (isodow({f}) - 1) + 7) % 7) + {7 * (n - 1)} AS INTEGER))"


def _last(m: int, wd: int) -> str:
    ld = f"last_day(make_date(y, {m}, 1))"
    return f"(CAST({ld} AS DATE) - CAST((((isodow({ld}) - 1) - {wd} + 7) % 7) AS INTEGER))"


def holidays_cte(src: str = "daily", cap: int = 14) -> str:
    """Rule-built US holidays for the years of ``src`` (padded by one) and the
    nearest-holiday distance table within ``cap`` days."""
    rows = []
    for name, expr in US_RULES_SQL:
        e = (expr.replace("{nth(1, 0, 3)}", _nth(1, 0, 3)).replace("{nth(2, 0, 3)}", _nth(2, 0, 3))
             .replace("{last(5, 0)}", _last(5, 0)).replace("{nth(9, 0, 1)}", _nth(9, 0, 1))
             .replace("{nth(11, 3, 4)}", _nth(11, 3, 4)))
        rows.append(f"SELECT '{name}' AS holiday, CAST({e} AS DATE) AS ds, y FROM years")
    union = "\n  UNION ALL ".join(rows)
    return f""",
years AS (
  SELECT CAST(unnest(range(CAST(min(year(date)) - 1 AS BIGINT), CAST(max(year(date)) + 2 AS BIGINT))) AS INTEGER) AS y
  FROM {src}
),
holidays AS (
  {union}
),
hol_dist AS (
  SELECT CAST(ds + CAST(o AS INTEGER) AS DATE) AS date, min(abs(o)) AS days_to_holiday
  FROM holidays, range(-{cap}, {cap + 1}) t(o)
  GROUP BY 1
)"""


def calendar_select(alias: str = "d", cap: int = 14) -> str:
    """Calendar feature columns of ``{alias}.date``; needs ``hol_dist h``."""
    d = f"{alias}.date"
    dow = f"(isodow({d}) - 1)"
    return f"""
    CAST({dow} AS INTEGER) AS day_of_week,
    CAST(day({d}) AS INTEGER) AS day_of_month,
    CAST(weekofyear({d}) AS INTEGER) AS week_of_year,
    CAST(month({d}) AS INTEGER) AS month,
    CAST(quarter({d}) AS INTEGER) AS quarter,
    CAST(year({d}) AS INTEGER) AS year,
    CAST({dow} >= 5 AS INTEGER) AS is_weekend,
    CAST(day({d}) = 1 AS INTEGER) AS is_month_start,
    CAST({d} = last_day({d}) AS INTEGER) AS is_month_end,
    CAST({d} = last_day({d}) AND month({d}) % 3 = 0 AS INTEGER) AS is_quarter_end,
    CAST(month({d}) >= 10 AS INTEGER) AS is_q4,
    CAST(day(last_day({d})) AS INTEGER) AS days_in_month,
    CAST(greatest(date_diff('day', {d}, last_day(make_date(year({d}), quarter({d}) * 3, 1))), 0) AS INTEGER) AS days_to_quarter_end,
    CAST(coalesce(h.days_to_holiday, {cap}) AS INTEGER) AS days_to_holiday,
    CAST(coalesce(h.days_to_holiday, {cap}) <= 3 AS INTEGER) AS near_holiday,
    sin({TWO_PI} * CAST({dow} AS DOUBLE) / 7.0) AS sin_week,
    cos({TWO_PI} * CAST({dow} AS DOUBLE) / 7.0) AS cos_week,
    sin({TWO_PI} * CAST(dayofyear({d}) AS DOUBLE) / 365.0) AS sin_year,
    cos({TWO_PI} * CAST(dayofyear({d}) AS DOUBLE) / 365.0) AS cos_year"""


def rolling_select(target: str = "revenue", alias: str = "d") -> str:
    """Rolling, lag, momentum and ewm columns over ``w`` (declared by caller
    as PARTITION BY series_key ORDER BY date)."""
    t = f"{alias}.{target}"
    w = f"PARTITION BY {alias}.series_key ORDER BY {alias}.date"
    parts = []
    for n in (7, 14, 28, 90):
        frame = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts.append(f"{r(f'sum({t}) OVER {frame}')} / nullif(count({t}) OVER {frame}, 0) AS roll_mean_{n}d")
        parts.append(f"coalesce(stddev_samp({t}) OVER {frame}, 0.0) AS roll_std_{n}d")
    for n in (7, 14, 28, 56):
        parts.append(f"lag({t}, {n}) OVER ({w}) AS lag_{n}d")
    parts.append(f"list({t}) OVER ({w} ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING) AS _prev")
    return ",\n    ".join(parts)


def metrics(y: str = "y", yhat: str = "yhat") -> str:
    """RMSE, MAE, MAPE and count of a group, not rounded."""
    e = f"({y} - {yhat})"
    return (f"sqrt(avg({e} * {e})) AS rmse, avg(abs{e}) AS mae, "
            f"avg(abs{e} / greatest({y}, 1.0)) * 100 AS mape, count(*) AS n_eval")


def shown(alias: str = "", prefix: str = "") -> str:
    """The three scores in cents."""
    dot = f"{alias}." if alias else ""
    return ", ".join(f"{r(dot + m)} AS {prefix}{m}" for m in ("rmse", "mae", "mape"))


def cv(src: str, keys: str = "series_key") -> str:
    """Means and population deviations of the scores in folds (keys, fold, rmse, mae, mape)."""
    return f"""
SELECT {keys}, {r('avg(rmse)')} AS cv_rmse_mean, {r('stddev_pop(rmse)')} AS cv_rmse_std,
       {r('avg(mae)')} AS cv_mae_mean, {r('stddev_pop(mae)')} AS cv_mae_std, {r('avg(mape)')} AS cv_mape_mean,
       count(*) AS n_folds
FROM {src} GROUP BY {keys}"""


EWM_ALPHA = 2.0 / 15.0


def ewm_expr(prev: str = "_prev") -> str:
    a = repr(EWM_ALPHA)
    b = repr(1.0 - EWM_ALPHA)
    return (f"CASE WHEN len({prev}) > 0 THEN list_reduce({prev}, "
            f"lambda acc, x: acc * {b} + x * {a}) END")


def forecast_ctes(horizon: int = 90, holdout: int = 90) -> str:
    """Twin of ``plans.forecasting.evaluate`` on top of ``feat``."""
    H = horizon
    return f""",
base AS (SELECT * FROM feat WHERE lag_56d IS NOT NULL),
idx AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY date) AS rn,
         count(*) OVER (PARTITION BY series_key) AS n,
         max(date) OVER (PARTITION BY series_key) AS last_date
  FROM base
),
ho AS (
  SELECT series_key, date, revenue AS y, greatest(lag_7d, 0.0) AS yhat, 'seasonal_naive' AS model
  FROM idx WHERE rn > n - {holdout}
  UNION ALL
  SELECT series_key, date, revenue AS y, greatest(roll_mean_28d, 0.0) AS yhat, 'moving_average' AS model
  FROM idx WHERE date > CAST(last_date - {holdout} AS DATE)
),
met AS (
  SELECT series_key, model, {metrics()}
  FROM ho GROUP BY series_key, model
),
wts AS (SELECT *, (1.0 / rmse) / sum(1.0 / rmse) OVER (PARTITION BY series_key) AS weight FROM met),
nm AS (SELECT series_key, count(*) AS m FROM wts GROUP BY series_key),
last_info AS (SELECT DISTINCT series_key, last_date, n FROM idx),
spine AS (
  SELECT s.series_key, CAST(s.last_date + CAST(t.h AS INTEGER) AS DATE) AS date, CAST(t.h AS INTEGER) AS h, s.n
  FROM last_info s, range(1, {H + 1}) t(h)
),
fc_a AS (
  SELECT sp.series_key, sp.date, sp.h, greatest(i.revenue, 0.0) AS yhat
  FROM spine sp JOIN idx i ON sp.series_key = i.series_key AND i.rn = sp.n - 7 + ((sp.h - 1) % 7) + 1
),
m28 AS (
  SELECT series_key, {r('sum(revenue)')} / count(revenue) AS m FROM idx WHERE rn > n - 28 GROUP BY series_key
),
alpha AS (
  SELECT series_key, quantile_cont(abs(y - yhat), 0.9) AS a FROM ho WHERE model = 'moving_average'
  GROUP BY series_key
),
fc_b AS (
  SELECT sp.series_key, sp.date, sp.h, greatest(m.m, 0.0) AS yhat,
         {r(f'greatest(greatest(m.m, 0.0) - a.a * (1.0 + 0.5 * (CAST(sp.h - 1 AS DOUBLE) / {float(H - 1)})), 0.0)')} AS yhat_lower,
         {r(f'greatest(m.m, 0.0) + a.a * (1.0 + 0.5 * (CAST(sp.h - 1 AS DOUBLE) / {float(H - 1)}))')} AS yhat_upper
  FROM spine sp JOIN m28 m ON sp.series_key = m.series_key LEFT JOIN alpha a ON sp.series_key = a.series_key
),
fc AS (
  SELECT series_key, date, h, yhat, 'seasonal_naive' AS model, CAST(NULL AS DOUBLE) AS yhat_lower,
         CAST(NULL AS DOUBLE) AS yhat_upper FROM fc_a
  UNION ALL
  SELECT series_key, date, h, yhat, 'moving_average' AS model, yhat_lower, yhat_upper FROM fc_b
),
ens AS (
  SELECT g.series_key, g.date, {r('g.y')} AS yhat_ensemble,
         {r('greatest(g.lo * 0.95, 0.0)')} AS ensemble_lower, {r('g.hi * 1.05')} AS ensemble_upper
  FROM (
    SELECT f.series_key, f.date, sum(w.weight * f.yhat) AS y, count(*) AS k,
           max(CASE WHEN f.model = 'moving_average' THEN f.yhat_lower END) AS lo,
           max(CASE WHEN f.model = 'moving_average' THEN f.yhat_upper END) AS hi
    FROM fc f JOIN wts w ON f.series_key = w.series_key AND f.model = w.model
    GROUP BY f.series_key, f.date
  ) g JOIN nm ON g.series_key = nm.series_key WHERE g.k = nm.m
),
eh AS (
  SELECT g.series_key, g.date, g.y, g.yhat FROM (
    SELECT h.series_key, h.date, sum(w.weight * h.yhat) AS yhat, first(h.y) AS y, count(*) AS k
    FROM ho h JOIN wts w ON h.series_key = w.series_key AND h.model = w.model
    GROUP BY h.series_key, h.date
  ) g JOIN nm ON g.series_key = nm.series_key WHERE g.k = nm.m
),
ens_met AS (
  SELECT series_key, {metrics()}
  FROM eh GROUP BY series_key
),
win AS (
  SELECT b.series_key, CASE WHEN e.rmse < b.best_rmse THEN 'ensemble' ELSE b.best END AS winner
  FROM (SELECT series_key, arg_min(model, (rmse, model)) AS best, min(rmse) AS best_rmse
        FROM met GROUP BY series_key) b
  LEFT JOIN ens_met e ON b.series_key = e.series_key
)"""
