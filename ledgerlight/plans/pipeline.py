"""End-to-end stages as lazy DataFrames: raw -> star -> clean -> daily features.

Nothing here collects data except ``distinct_values``, which reads the
distinct values of a low-cardinality dimension attribute (segments,
categories) to fix the pivot schema, and refuses more than ``max_values``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.calendar import add_calendar_features
from ledgerlight.operators.clean import (JUDGED_COUNTS, TYPED_COUNTS, accepted, audit_row, clean_customers,
                                         clean_products, dirty_transactions, judged_transactions,
                                         typed_transactions)
from ledgerlight.operators.daily import aggregate_daily
from ledgerlight.operators.ingest import ingest
from ledgerlight.operators.series import add_rolling_and_lags
from ledgerlight.operators.ingest import CUSTOMER_COLUMNS, PRODUCT_COLUMNS
from ledgerlight.plans.stages import Observed, enabled, observed_stage, stage
from ledgerlight.sources.holidays import holidays_for
from ledgerlight.sources.io import by_month
from ledgerlight.sources.tables import raw_sales, read_table


@dataclass
class Params:
    """Business rules that the reference hard-codes, as parameters.

    Defaults are the values used on the driver's test tables (FIXTURES.md):
    the reference's own rule (category 'Technology' or >= 3 customers) marks
    every product recurring there.
    """
    recurring_category: str = "PROMO"
    min_customers: int = 30
    cap_q: float = 0.995
    order_cols: tuple = ("part_key", "supp_key")
    salt: str | None = None


def distinct_values(df: DataFrame, col: str, max_values: int = 1000) -> list[str]:
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct()
            .limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} values; too wide to pivot")
    return sorted(vals)


def segment_values(spark: SparkSession, sf_dir: str) -> list[str]:
    return distinct_values(read_table(spark, sf_dir, "customer"), "c_mktsegment")


def category_values(spark: SparkSession, sf_dir: str) -> list[str]:
    return distinct_values(read_table(spark, sf_dir, "part"), "p_type")


def _pkey(p: Params) -> tuple:
    return (p.recurring_category, p.min_customers, p.cap_q, tuple(p.order_cols), p.salt)


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw sales table, written once."""
    return stage(spark, ("raw", sf_dir), lambda: raw_sales(spark, sf_dir))


def star_full(spark: SparkSession, sf_dir: str, p: Params | None = None):
    """customers (with the raw key and spend), products (with counts) and
    transactions (with helper columns), each written once as a stage table."""
    from ledgerlight.operators.ingest import build_customers, build_products, build_transactions
    p = p or Params()
    key = (sf_dir, _pkey(p))
    raw = raw_table(spark, sf_dir)
    customers_k = stage(spark, ("customers",) + key,
                        lambda: build_customers(raw, keep_key=True, salt=p.salt))
    products = stage(spark, ("products",) + key,
                     lambda: build_products(raw, p.recurring_category, p.min_customers))
    txn = stage(spark, ("transactions",) + key,
                lambda: build_transactions(raw, customers_k, products, salt=p.salt, dealt=_monthly))
    return customers_k, products, txn


def _monthly(joined: DataFrame) -> DataFrame:
    """Dealt by month for the table of transactions, whose rows then are the fact's where they lie."""
    return by_month(joined, "order_date") if enabled() else joined


def build_stages(spark: SparkSession, sf_dir: str, p: Params | None = None,
                 features=None, max_workers: int = 4) -> None:
    """Write every stage table for ``sf_dir`` up front.  Independent tables
    (customer and product dimensions; clean and dirty-clean tables; feature
    tables) are written as concurrent Spark jobs from a small driver thread
    pool, so narrow single-file scans do not leave the cluster idle.
    ``features`` is an optional list of zero-argument callables building
    feature tables once the clean tables exist."""
    from concurrent.futures import ThreadPoolExecutor
    from ledgerlight.operators.ingest import build_customers, build_products
    p = p or Params()
    key = (sf_dir, _pkey(p))
    raw = raw_table(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        list(pool.map(lambda f: f(), [
            lambda: stage(spark, ("customers",) + key, lambda: build_customers(raw, keep_key=True, salt=p.salt)),
            lambda: stage(spark, ("products",) + key,
                          lambda: build_products(raw, p.recurring_category, p.min_customers)),
        ]))
        star_full(spark, sf_dir, p)
        list(pool.map(lambda d: clean_star(spark, sf_dir, p, d), [False, True]))
        if features:
            list(pool.map(lambda f: f(), features))


def star(spark: SparkSession, sf_dir: str, p: Params | None = None):
    """customers, products, transactions straight from ingest (transactions
    keep helper columns; duplicates of ``transaction_id`` are still there)."""
    c, pr, t = star_full(spark, sf_dir, p)
    return c.select(*CUSTOMER_COLUMNS), pr.select(*PRODUCT_COLUMNS), t


def _clean(spark: SparkSession, sf_dir: str, p: Params | None, dirty: bool):
    """Cleaned customers, products, fact, what makes the deduplicated rows, and the counts of the judged ones."""
    p = p or Params()
    customers, products, txn = star(spark, sf_dir, p)
    if dirty:
        txn = dirty_transactions(txn)
    key = (sf_dir, _pkey(p), dirty)
    c = stage(spark, ("clean_customers",) + key, lambda: clean_customers(customers))
    pr = stage(spark, ("clean_products",) + key, lambda: clean_products(products))
    staged = _staged(spark, "clean", key)
    typed = lambda: typed_transactions(txn, p.order_cols, staged)  # noqa: E731  it counts the repeated hashes
    fact, judged = observed_stage(spark, ("clean_fact",) + key, lambda: Observed(
        judged_transactions(typed(), c, pr, p.cap_q, staged), JUDGED_COUNTS, accepted, monthly=True))
    return c, pr, fact, typed, judged


def _staged(spark: SparkSession, name: str, key: tuple):
    """Writes the small tables that decide about rows; none if everything stays one lazy plan."""
    return (lambda part, build: stage(spark, (f"{name}_{part}",) + key, build)) if enabled() else None


def clean_star(spark: SparkSession, sf_dir: str, p: Params | None = None, dirty: bool = False):
    return _clean(spark, sf_dir, p, dirty)[:3]


def csv_star(spark: SparkSession, path: str, p: Params | None = None, max_malformed: int = 0):
    """S1 to the star: customers, products, transactions of a raw CSV file, and its malformed lines.

    The file's lines are written once, as they stand in the file.  More than
    ``max_malformed`` lines that don't fit the schema, missing columns (P10)
    and transactions without a customer or product (J5) are errors.
    """
    from ledgerlight.operators.ingest import (TRANSACTION_COLUMNS, assert_columns, assert_no_orphans, build_customers,
                                              build_products, build_transactions, numbered_id)
    from ledgerlight.sources.io import MALFORMED, RAW_CSV_SCHEMA, raw_from_csv, read_raw_csv
    p = p or Params()
    key = (path, _pkey(p))
    lines, counted = observed_stage(spark, ("csv_lines", path), lambda: Observed(
        read_raw_csv(spark, path), {"malformed": f"count_if({MALFORMED} IS NOT NULL)"}))
    assert_columns(lines, RAW_CSV_SCHEMA.fieldNames())
    if counted["malformed"] > max_malformed:
        raise ValueError(f"{counted['malformed']} lines of {path} don't fit the schema")
    raw, order = raw_from_csv(lines), ("_place",)
    customers = stage(spark, ("csv_customers",) + key,
                      lambda: build_customers(raw, keep_key=True, salt=p.salt, order=order))
    products = stage(spark, ("csv_products",) + key,
                     lambda: build_products(raw, p.recurring_category, p.min_customers, order=order))
    txn = stage(spark, ("csv_transactions",) + key, lambda: build_transactions(
        raw, customers, products, salt=p.salt, txn_id=numbered_id, helpers=("order_key", "_place")))
    assert_columns(txn, TRANSACTION_COLUMNS)
    assert_no_orphans(txn, customers, products)
    return (customers.select(*CUSTOMER_COLUMNS), products.select(*PRODUCT_COLUMNS), txn,
            lines.where(F.col(MALFORMED).isNotNull()))


def csv_clean_fact(spark: SparkSession, path: str, p: Params | None = None, max_malformed: int = 0) -> DataFrame:
    """The cleaned transaction fact of a raw CSV file."""
    from ledgerlight.operators.clean import clean_all
    p = p or Params()
    customers, products, txn, _ = csv_star(spark, path, p, max_malformed)
    return stage(spark, ("csv_clean_fact", path, _pkey(p)), lambda: clean_all(
        customers, products, txn, ("_place",), p.cap_q, _staged(spark, "csv", (path, _pkey(p))))[2])


def clean_fact(spark: SparkSession, sf_dir: str, p: Params | None = None, dirty: bool = False) -> DataFrame:
    return clean_star(spark, sf_dir, p, dirty)[2]


def daily_features(txn: DataFrame, series: str | Column | None = None,
                   breakdowns: dict | None = None, holidays: DataFrame | str = "us",
                   approx_distinct: bool = False, materialize=None) -> DataFrame:
    """The reference's ``daily_features`` table for every series at once:
    aggregates and ratios, calendar block, rolling / lag / ewm block, and the
    per-segment and per-category revenue columns.  ``materialize`` (optional)
    writes the daily aggregate once; the holiday years and the windows then
    read that small table instead of aggregating the fact again."""
    daily = aggregate_daily(txn, series, approx_distinct, breakdowns)
    if materialize is not None:
        daily = materialize(daily)
    if isinstance(holidays, str):
        holidays = holidays_for(daily, holidays)
    daily = add_calendar_features(daily, holidays)
    return add_rolling_and_lags(daily)


def clean_audit_table(spark: SparkSession, sf_dir: str, p: Params | None = None, dirty: bool = True) -> DataFrame:
    """What was counted while the fact was written, and one pass over the deduplicated rows, once a session."""
    *_, typed, judged = _clean(spark, sf_dir, p, dirty)
    _, removed = observed_stage(spark, ("clean_counts", sf_dir, _pkey(p or Params()), dirty), lambda: Observed(
        typed().selectExpr(*[f"{sql} AS {name}" for name, sql in TYPED_COUNTS.items()]),
        {name: f"max({name})" for name in TYPED_COUNTS}))
    return audit_row(spark, removed | judged)
