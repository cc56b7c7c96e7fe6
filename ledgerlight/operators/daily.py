"""Daily series from the fact.

Every series operator works on many series at once: the key is
``(series_key, date)`` where ``series_key`` is a literal ``"total"`` (the
reference's single series) or any fact column such as the segment.  Sums and
counts are partial-aggregated on the map side, so a hot day or a hot series
is reduced before the shuffle; the two exact distinct counts are planned by
Catalyst as one ``Expand`` over (date, customer) and (date, product) pairs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up, safe_ratio

DAILY_AGG_COLUMNS = [
    "revenue", "gross_profit", "n_transactions", "n_customers", "n_products",
    "avg_order_value", "avg_discount", "avg_quantity", "recurring_rev",
    "gp_margin", "recurring_share", "rev_per_customer",
]


def with_series_key(df: DataFrame, series: str | Column | None = None) -> DataFrame:
    """Add ``series_key``: ``None`` gives the single series ``"total"``."""
    if series is None:
        key = F.lit("total")
    elif isinstance(series, str):
        key = F.col(series).cast("string")
    else:
        key = series.cast("string")
    return df.withColumn("series_key", key)


def aggregate_daily(txn: DataFrame, series: str | Column | None = None,
                    approx_distinct: bool = False,
                    breakdowns: dict[str, Sequence[str]] | None = None,
                    sanitize: bool = False) -> DataFrame:
    """A1-A3: one row per observed (series_key, date).

    ``breakdowns`` (A10/A11) adds the per-value revenue columns inside the
    same aggregate, so the fact is scanned and shuffled once for all of them.
    """
    src = with_series_key(txn, series)
    if series is not None:
        # pandas groupby drops null keys
        src = src.where(F.col("series_key").isNotNull())
    distinct = (lambda c: F.approx_count_distinct(c)) if approx_distinct else (
        lambda c: F.countDistinct(c))
    # Money columns are sums of cents: rounding the sum to cents removes only
    # floating-point noise and makes every later ratio and window independent
    # of summation order.
    daily = src.groupBy("series_key", "date").agg(
        money_sum(F.col("revenue")).alias("revenue"),
        money_sum(F.col("gross_profit")).alias("gross_profit"),
        F.count("transaction_id").alias("n_transactions"),
        distinct("customer_id").alias("n_customers"),
        distinct("product_id").alias("n_products"),
        F.try_divide(money_sum(F.col("revenue")), F.count("revenue")).alias("avg_order_value"),
        F.try_divide(money_sum(F.col("discount_pct"), 4), F.count("discount_pct")).alias("avg_discount"),
        F.avg("quantity").alias("avg_quantity"),
        money_sum(F.when(F.col("is_recurring"), F.col("revenue")).otherwise(F.lit(0.0))).alias("recurring_rev"),
        *[_pivot_sum(by, v, "revenue", "rev_", sanitize)
          for by, values in (breakdowns or {}).items() for v in values],
    )
    return daily.withColumns({
        "gp_margin": round_half_up(F.try_divide("gross_profit", "revenue"), 4),
        "recurring_share": round_half_up(F.try_divide("recurring_rev", "revenue"), 4),
        "rev_per_customer": round_half_up(F.try_divide("revenue", "n_customers"), 2),
    })


def money_sum(x: Column, digits: int = 2) -> Column:
    """Sum of values with ``digits`` decimals, rounded back to ``digits``."""
    return round_half_up(F.sum(x), digits)


def pivot_name(prefix: str, value: str, sanitize: bool = False) -> str:
    """``rev_<lower(value)>``; spaces are kept unless ``sanitize``."""
    name = f"{prefix}{value.lower()}"
    return re.sub(r"\s+", "_", name) if sanitize else name


def _pivot_sum(by: str, v: str, value_col: str, prefix: str, sanitize: bool) -> Column:
    return (F.coalesce(money_sum(F.when(F.col(by) == F.lit(v), F.col(value_col))), F.lit(0.0))
            .alias(pivot_name(prefix, v, sanitize)))


def pivot_revenue(txn: DataFrame, by: str, values: Sequence[str], series: str | Column | None = None,
                  value_col: str = "revenue", prefix: str = "rev_", sanitize: bool = False) -> DataFrame:
    """Revenue per (series_key, date) spread over ``values`` of ``by``,
    zero where a value has no rows that day.  The value list is explicit so
    the schema is fixed at plan time and no distinct pass is needed."""
    src = with_series_key(txn, series).where(F.col(by).isNotNull())
    return src.groupBy("series_key", "date").agg(*[
        _pivot_sum(by, v, value_col, prefix, sanitize) for v in values])
