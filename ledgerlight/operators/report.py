"""Report aggregates.

Each function returns a small DataFrame; ``eda_report`` has their numbers in
long form from one pass over the sales and one over the days.  Means of money or 4-decimal ratios are
computed as a rounded sum over a count so that the result does not depend
on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlight.functions.calendar import day_name, year_month
from ledgerlight.functions.numeric import round_half_up as rh
from ledgerlight.operators.quantiles import exact_quantiles, with_scalars
from ledgerlight.sources.io import between


def fixed_mean(col: str, digits: int) -> F.Column:
    """Mean of values that carry ``digits`` decimals."""
    return F.try_divide(rh(F.sum(col), digits), F.count(col))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema type (booleans excluded)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def customer_rfm(txn: DataFrame, customers: DataFrame) -> DataFrame:
    """A12 + J8: recency against the last date of the fact, frequency,
    monetary, average order, first / last purchase, CLV proxy
    (monetary / max(freq, 1)) * ln(1 + freq), plus customer attributes."""
    cutoff = txn.agg(F.max("date").alias("_cutoff"))
    per = txn.groupBy("customer_id").agg(
        F.max("date").alias("last_purchase"),
        F.min("date").alias("first_purchase"),
        F.count("transaction_id").alias("frequency"),
        rh(F.sum("revenue"), 2).alias("monetary"),
        F.count("revenue").alias("_nrev"),
    )
    rfm = with_scalars(per, cutoff).select(
        "customer_id",
        F.datediff("_cutoff", "last_purchase").alias("recency_days"),
        "frequency", "monetary",
        F.try_divide(F.col("monetary"), F.col("_nrev")).alias("avg_order"),
        "first_purchase", "last_purchase",
        (F.col("monetary") / F.greatest(F.col("frequency"), F.lit(1))
         * F.log1p(F.col("frequency").cast("double"))).alias("clv_proxy"),
    )
    attrs = customers.select("customer_id", "segment", "region", "account_tier", "tenure_days")
    return rfm.join(attrs, "customer_id", "left")


def overview(txn: DataFrame, daily: DataFrame) -> DataFrame:
    """A13."""
    t = txn.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        rh(F.sum("revenue"), 2).alias("total_revenue"),
        F.countDistinct("customer_id").alias("total_customers"),
        F.countDistinct("product_id").alias("total_products"),
        F.concat(F.min("date").cast("string"), F.lit(" to "), F.max("date").cast("string")).alias("date_range"),
    )
    d = daily.agg(
        rh(fixed_mean("revenue", 2), 2).alias("avg_daily_revenue"),
        rh(F.stddev_samp("revenue"), 2).alias("revenue_std"),
    )
    med = exact_quantiles(daily, "revenue", {"_median": 0.5}).select(
        rh("_median", 2).alias("median_daily_revenue"))
    return with_scalars(with_scalars(t, d), med)


def group_summary(txn: DataFrame, by: str) -> DataFrame:
    """Total, mean order and count per value of ``by`` (nulls dropped)."""
    return (txn.where(F.col(by).isNotNull()).groupBy(by).agg(
        rh(F.sum("revenue"), 2).alias("total"),
        rh(fixed_mean("revenue", 2), 2).alias("avg_order"),
        F.count("revenue").alias("count")))


def monthly_revenue(txn: DataFrame) -> DataFrame:
    """A16."""
    return (txn.groupBy(year_month("date").alias("month"))
               .agg(rh(F.sum("revenue"), 2).alias("revenue")))


def mean_by_day_name(daily: DataFrame) -> DataFrame:
    """A17."""
    return daily.groupBy(day_name("date").alias("dow_name")).agg(
        rh(fixed_mean("revenue", 2), 2).alias("avg_revenue"))


def mean_by_month(daily: DataFrame) -> DataFrame:
    """A18."""
    return daily.groupBy(F.month("date").alias("month")).agg(
        rh(fixed_mean("revenue", 2), 2).alias("avg_revenue"))


def discount_analysis(txn: DataFrame) -> DataFrame:
    """A19."""
    n = F.count("discount_pct")
    return txn.agg(
        rh(F.try_divide(rh(F.sum("discount_pct"), 4), n) * 100, 2).alias("avg_discount_pct"),
        rh(F.try_divide(F.sum(F.when(F.col("discount_pct") > 0, 1).otherwise(0)).cast("double"),
                        F.count(F.lit(1))) * 100, 2).alias("pct_transactions_discounted"),
        rh(F.coalesce(F.sum(F.when(F.col("discount_pct") == 0, F.col("revenue"))), F.lit(0.0)), 2)
        .alias("revenue_at_zero_discount"),
        rh(F.coalesce(F.sum(F.when(F.col("discount_pct") > 0, F.col("revenue"))), F.lit(0.0)), 2)
        .alias("revenue_with_discount"),
    )


def profitability(txn: DataFrame, daily: DataFrame) -> DataFrame:
    """Means of the daily ratios (not ratios of sums)."""
    d = daily.agg(
        rh(fixed_mean("gp_margin", 4) * 100, 2).alias("avg_gp_margin_pct"),
        rh(fixed_mean("recurring_share", 4) * 100, 2).alias("recurring_rev_share"),
    )
    t = txn.agg(rh(F.sum("gross_profit"), 2).alias("total_gross_profit"))
    return with_scalars(d, t).select("avg_gp_margin_pct", "total_gross_profit", "recurring_rev_share")


def _corr(v: str, w: str) -> F.Column:
    """Pearson correlation over pairwise-complete rows; null (not an error)
    when either side is constant (trap 2)."""
    vv, ww = F.col(v).cast("double"), F.col(w).cast("double")
    both = vv.isNotNull() & ww.isNotNull()
    sd_v = F.stddev_pop(F.when(both, vv))
    sd_w = F.stddev_pop(F.when(both, ww))
    return F.try_divide(F.covar_pop(vv, ww), sd_v * sd_w)


def correlations(daily: DataFrame, target: str = "revenue", cols: Sequence[str] | None = None,
                 top: int | None = 15, digits: int = 4) -> DataFrame:
    """A21 + O3: correlation of every numeric column with ``target`` in one
    aggregate pass, unpivoted, strongest ``top`` by absolute value."""
    cols = list(cols) if cols is not None else numeric_columns(daily, exclude=[target, "date"])
    # unpivot first: one (feature, v, w) row per input row and feature, then
    # a three-function aggregate per feature (small code, one shuffle)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                      for c in cols])
    long = (daily.select(F.col(target).cast("double").alias("_w"), F.explode(pairs).alias("_p"))
                 .select("_p.feature", "_p.v", "_w")
                 .groupBy("feature").agg(_corr("v", "_w").alias("corr"))
                 .withColumn("corr", rh("corr", digits)))
    ranked = long.orderBy(F.abs("corr").desc_nulls_last(), "feature")
    return ranked.limit(top) if top else ranked


def outliers(daily: DataFrame) -> DataFrame:
    """p1 / p99 of daily revenue and the days beyond them."""
    q = exact_quantiles(daily, "revenue", {"_p01": 0.01, "_p99": 0.99})
    return with_scalars(daily, q).agg(
        rh(F.first("_p01"), 2).alias("p1_daily_revenue"),
        rh(F.first("_p99"), 2).alias("p99_daily_revenue"),
        F.sum(F.when(F.col("revenue") > F.col("_p99"), 1).otherwise(0)).cast("long").alias("days_above_p99"),
        F.sum(F.when(F.col("revenue") < F.col("_p01"), 1).otherwise(0)).cast("long").alias("days_below_p01"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column (long form)."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in cols])
    stack = "stack({n}, {pairs}) as (column_name, null_count)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(stack)


def share_of_total(df: DataFrame, by: str, value: str = "revenue", digits: int = 2,
                   total: str | None = None) -> DataFrame:
    """Value per group and its percentage of the total, which is added as column ``total`` if named.

    The total is a one-row aggregate attached by broadcast (no single-
    partition window)."""
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        rh(F.sum(value), 2).alias(value), F.count(F.lit(1)).alias("n_transactions"))
    tot = g.agg(rh(F.sum(value), 2).alias("_total"))
    return with_scalars(g, tot).select(
        by, value, "n_transactions",
        rh(F.try_divide(F.col(value), F.col("_total")) * 100, digits).alias("share_pct"),
        *([F.col("_total").alias(total)] if total else []))


def best_worst(df: DataFrame, value: str, key: str) -> DataFrame:
    """Flag the rows holding the largest and smallest value."""
    ext = df.agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    return with_scalars(df, ext).select(
        key, value,
        F.when(F.col(value) == F.col("_max"), "best")
         .when(F.col(value) == F.col("_min"), "worst").otherwise("").alias("marker"))


def _cells(section: str, key, metrics: dict) -> F.Column:
    """An array of report rows: name and value, or name and (None, text)."""
    cells = []
    for name, v in metrics.items():
        value, text = v if isinstance(v, tuple) else (v, None)
        value = F.lit(None).cast("double") if value is None else value.cast("double")
        text = F.lit(None).cast("string") if text is None else text
        cells.append(F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"),
                              F.lit(name).alias("metric"), value.alias("value"), text.alias("text")))
    return F.array(*cells)


def _by_set(grouped: DataFrame, cells: dict[str, F.Column], columns: Sequence[str]) -> DataFrame:
    """The report rows of each grouping set, named by the column it groups by ("" for all rows)."""
    every = 2 ** len(columns) - 1
    made = None
    for name, cell in cells.items():
        mine = every if name == "" else every - 2 ** (len(columns) - 1 - list(columns).index(name))
        here = F.col("_set") == mine
        if name:
            here = here & F.col(name).isNotNull()
        made = F.when(here, cell) if made is None else made.when(here, cell)
    return grouped.select(F.inline(made))


def eda_report(fact: DataFrame, days: DataFrame, features: Sequence[str], start=None, end=None) -> DataFrame:
    """Q7: the report in long form (section, key, metric, value, text).

    One aggregate by grouping sets over the fact and one over the days, of
    which ``days`` is one series with all its features; and one pass for the
    correlations.  Distinct customers and products are grouping sets too:
    their number is that of the set's rows.  Lists and percentiles are only
    made of days, so they are bounded by the calendar.  A range without sales
    has no rows.
    """
    sales = ["segment", "category", "_month", "customer_id", "product_id"]
    money = lambda x: rh(x, 2)
    discounted = F.col("discount_pct") > 0
    by_sale = between(fact, start, end).withColumn("_month", year_month("date"))
    by_sale = by_sale.groupingSets([[], *[[c] for c in sales]], *sales).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count("revenue").alias("n_revenue"),
        money(F.sum("revenue")).alias("revenue"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.count("discount_pct").alias("n_discount"), rh(F.sum("discount_pct"), 4).alias("discount"),
        F.count_if(discounted).alias("n_discounted"),
        F.sum(F.when(F.col("discount_pct") == 0, F.col("revenue"))).alias("at_zero"),
        F.sum(F.when(discounted, F.col("revenue"))).alias("with_discount"),
        money(F.sum("gross_profit")).alias("gross_profit"))
    none, one = F.lit(""), F.lit(1.0)
    zero = lambda c: money(F.coalesce(F.col(c), F.lit(0.0)))
    share = lambda a, b: money(F.try_divide(F.col(a).cast("double"), F.col(b)) * 100)
    group = {"total": F.col("revenue"), "avg_order": money(F.try_divide("revenue", "n_revenue")), "count": F.col("n_revenue")}
    overall = F.concat(
        _cells("overview", none, {
            "total_transactions": F.col("n"), "total_revenue": F.col("revenue"),
            "date_range": (None, F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string")))}),
        _cells("discount_analysis", none, {
            "avg_discount_pct": share("discount", "n_discount"), "pct_transactions_discounted": share("n_discounted", "n"),
            "revenue_at_zero_discount": zero("at_zero"), "revenue_with_discount": zero("with_discount")}),
        _cells("profitability", none, {"total_gross_profit": F.col("gross_profit")}))
    from_sales = _by_set(by_sale, {
        "": overall, "segment": _cells("by_segment", F.col("segment"), group),
        "category": _cells("by_category", F.col("category"), group),
        "_month": _cells("monthly_revenue", F.col("_month"), {"revenue": F.col("revenue")}),
        "customer_id": _cells("overview", none, {"total_customers": one}),
        "product_id": _cells("overview", none, {"total_products": one})}, sales)

    dates = ["_dow", "_month"]
    chosen = between(days, start, end)
    mean = lambda c, d: F.try_divide(rh(F.sum(c), d), F.count(c))
    by_day = chosen.withColumns({"_dow": day_name("date"), "_month": F.month("date").cast("string")})
    by_day = by_day.groupingSets([[], *[[c] for c in dates]], *dates).agg(
        F.grouping_id().alias("_set"), money(mean("revenue", 2)).alias("mean"),
        money(F.stddev_samp("revenue")).alias("std"),
        F.percentile("revenue", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("p"),
        F.collect_list("revenue").alias("all"), money(mean("gp_margin", 4) * 100).alias("margin"),
        money(mean("recurring_share", 4) * 100).alias("recurring"))
    at = lambda i: F.get("p", F.lit(i))
    beyond = lambda far: F.size(F.filter("all", far))
    avg = {"avg_revenue": F.col("mean")}
    from_days = _by_set(by_day, {
        "": F.concat(
            _cells("overview", none, {"avg_daily_revenue": F.col("mean"), "median_daily_revenue": money(at(1)),
                                      "revenue_std": F.col("std")}),
            _cells("profitability", none, {"avg_gp_margin_pct": F.col("margin"), "recurring_rev_share": F.col("recurring")}),
            _cells("outliers", none, {
                "p1_daily_revenue": money(at(0)), "p99_daily_revenue": money(at(2)),
                "days_above_p99": beyond(lambda x: x > at(2)), "days_below_p01": beyond(lambda x: x < at(0))})),
        "_dow": _cells("avg_revenue_by_dow", F.col("_dow"), avg),
        "_month": _cells("avg_revenue_by_month", F.col("_month"), avg)}, dates)

    corr = correlations(chosen, "revenue", features, top=15)
    from_corr = corr.select(F.inline(_cells("top_correlated_features", F.col("feature"), {"corr": F.col("corr")})))
    # one row each, but for the distinct counts
    return (from_sales.unionByName(from_days).unionByName(from_corr).groupBy("section", "key", "metric")
            .agg(F.sum("value").alias("value"), F.max("text").alias("text")))


def frame_summary(df: DataFrame, date_col: str = "date", value_col: str = "revenue") -> DataFrame:
    """Row and column count, date range and value range of a frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
                  F.min(value_col).alias("min_value"), F.max(value_col).alias("max_value"))
