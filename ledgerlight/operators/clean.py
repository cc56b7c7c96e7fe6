"""Cleaning (W6, P4-P7, A9, J4, J6, F4, S9) and the dirty fixture.

Order of steps follows the reference: keep-first dedup, type coercion,
non-positive revenue filter, per-category winsorising at the 99.5th
percentile, null drop on critical fields, clips, gross profit recomputed
from the capped revenue, then referential integrity against the cleaned
dimensions.

Keep-first dedup is the least row grouped by the key, an ordinary aggregate
with map-side partial aggregation, so a key repeated across a third of the
table is reduced on every map task before the shuffle instead of being sorted
in one window partition.

What decides about rows is small next to them: hashes of ids that come twice,
caps, keys that no dimension has.  With ``staged`` these are tables of their
own, written first; the planner then knows how small they are and brings them
to the rows, which stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.ids import pseudonym
from ledgerlight.functions.numeric import clip, round_half_up
from ledgerlight.operators.ingest import HELPER_COLUMNS, TRANSACTION_COLUMNS
from ledgerlight.operators.quantiles import exact_quantiles
from ledgerlight.sources.io import MONTH

CRITICAL = ("date", "customer_id", "product_id", "revenue")

#: Gives the table of a name, written by its builder on first use.
Staged = Callable[[str, Callable[[], DataFrame]], DataFrame]
#: Up to so many hashes (8 bytes each) go to every task; more are joined by a shuffle.
HASHES_TO_ALL = 4_000_000
#: The same for rows with names of categories, customers or products.
KEYS_TO_ALL = 100_000


def brought(df: DataFrame, small: DataFrame, at_most: int) -> tuple[DataFrame, DataFrame]:
    """``df`` and ``small``, a written table, for a join.  Up to ``at_most`` rows are brought to ``df``, whose
    rows stay where they are; otherwise the join deals them anew, and they lose the month they were dealt by."""
    return (df, F.broadcast(small)) if small.count() <= at_most else (df.drop(MONTH), small)


def keep_first(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str],
               copies: str | None = None) -> DataFrame:
    """Keep the first row of each key under ``order_cols`` (ties broken by the
    remaining columns, so the choice is deterministic).

    The least row, its columns in that order, grouped by the key: one shuffle,
    after map-side partial aggregation, so a key that a third of the rows share
    is one row a task before anything moves.  ``copies`` names a column for the
    number of rows of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in order_cols] + [c for c in rest if c not in order_cols]
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in ordered])).alias("_row"), *counted)
    flat = picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], *[copies] * bool(copies))
    return flat.select(*df.columns, *[copies] * bool(copies))


def keep_first_of_repeated(df: DataFrame, key: str, order_cols: Sequence[str], copies: str, staged: Staged) -> DataFrame:
    """``keep_first`` of rows most of whose keys come once.

    Only hashes of the keys are shuffled to find those that come twice.  Rows
    with other hashes are passed on as they are; the rest, among them all
    rows of a key that comes twice, go through ``keep_first``."""
    repeated = staged("repeated", lambda: df.groupBy(F.xxhash64(key).alias("_h")).agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h"))
    df, repeated = brought(df, repeated, HASHES_TO_ALL)
    hashed = df.withColumn("_h", F.xxhash64(key))
    once = hashed.join(repeated, "_h", "left_anti").select(*df.columns, F.lit(1).cast("long").alias(copies))
    again = hashed.join(repeated, "_h", "left_semi").select(*df.columns)
    return once.unionByName(keep_first(again, key, order_cols, copies))


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers from text, unparsable values to null (no exceptions)."""
    def num(c, t):
        return F.col(c).cast("string").try_cast(t) if dict(df.dtypes)[c] == "string" else F.col(c).cast(t)
    return df.withColumns({
        "date": F.to_date("date"),
        "quantity": num("quantity", "long"),
        "revenue": num("revenue", "double"),
        "unit_price": num("unit_price", "double"),
        "discount_pct": num("discount_pct", "double"),
        "gross_profit": num("gross_profit", "double"),
    })


def revenue_caps(df: DataFrame, q: float = 0.995, staged: Staged | None = None) -> DataFrame:
    """Per-category cap; null categories get none (pandas drops null keys).

    The interpolated percentile is rounded to cents: revenue is in cents, so
    this changes a capped value by less than half a cent and keeps the
    result independent of the engine's interpolation arithmetic."""
    caps = exact_quantiles(df.where(F.col("category").isNotNull()), "revenue",
                           {"revenue_cap": q}, ["category"],
                           staged=staged and (lambda name, build: staged(f"cap_{name}", build)))
    return caps.withColumn("revenue_cap", round_half_up("revenue_cap", 2))


#: Counted of the deduplicated rows.
TYPED_COUNTS = {
    "rows_in": "sum(_copies)",
    "rows_deduped": "count(*)",
    "unparsable_quantity": "count_if(quantity IS NULL)",
}


def typed_transactions(txn: DataFrame, order_cols: Sequence[str] = ("part_key", "supp_key"),
                       staged: Staged | None = None) -> DataFrame:
    """One row per transaction id, coerced to its types, and how many rows it stands for (``_copies``)."""
    if staged is None:
        return coerce_types(keep_first(txn, "transaction_id", order_cols, copies="_copies"))
    return coerce_types(keep_first_of_repeated(txn, "transaction_id", order_cols, "_copies", staged))


def _positive() -> Column:
    # pandas keeps a null revenue at this filter (NaN <= 0 is False)
    return F.col("revenue").isNull() | (F.col("revenue") > 0)


#: Counted of the judged rows (S9); ``_before`` is the revenue before capping.
JUDGED_COUNTS = {
    "rows_positive": "count(*)",
    "rows_non_null": "count_if(_whole)",
    "rows_out": "count_if(_whole AND _known)",
    "discount_at_cap": "count_if(_whole AND discount_pct >= 0.5)",
    "mean_revenue_before_cap": "avg(_before)",
    "mean_revenue_after_cap": "avg(revenue)",
}


def unknown_keys(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` that ``dimension`` lacks, each once, and ``_lost_<key>``."""
    used = df.select(key).where(F.col(key).isNotNull()).distinct()
    return used.join(dimension.select(key), key, "left_anti").withColumn(f"_lost_{key}", F.lit(True))


def judged_transactions(typed: DataFrame, customers: DataFrame, products: DataFrame, cap_q: float = 0.995,
                        staged: Staged | None = None) -> DataFrame:
    """Rows with positive revenue, capped and clipped, and whether they have
    all critical fields (``_whole``) and rows in both dimensions (``_known``).

    Both flags are columns rather than filters, so that one pass over the rows
    counts what every later step removes."""
    positive = typed.drop("_copies").where(_positive())
    put = staged or (lambda name, build: build())
    caps = put("caps", lambda: revenue_caps(positive, cap_q, staged))
    lies, caps = brought(positive, caps, KEYS_TO_ALL) if staged else (positive, caps)
    capped = lies.join(caps, "category", "left").withColumns({
        "_before": F.col("revenue"),
        "revenue": F.when(F.col("revenue").isNotNull(),
                          F.least(F.col("revenue"), F.coalesce(F.col("revenue_cap"), F.lit(float("inf"))))),
    }).drop("revenue_cap")
    whole = F.lit(True)
    for c in CRITICAL:
        whole = whole & F.col(c).isNotNull()
    final = capped.withColumns({
        "_whole": whole,
        "discount_pct": clip("discount_pct", 0.0, 0.5),
        "quantity": clip("quantity", 1),
        "gross_profit": round_half_up(F.col("revenue") - F.col("cost"), 2),
    })
    known = F.lit(True)
    for key, dimension in (("customer_id", customers), ("product_id", products)):
        lost = put(f"unknown_{key}", lambda: unknown_keys(positive, dimension, key))
        final, lost = brought(final, lost, KEYS_TO_ALL) if staged else (final, lost)
        final = final.join(lost, key, "left")
        known = known & F.col(key).isNotNull() & F.col(f"_lost_{key}").isNull()
    return (final.withColumn("_known", known)
            .select(*[c for c in positive.columns if c in final.columns], "_before", "_whole", "_known"))


def accepted(judged: DataFrame) -> DataFrame:
    """The rows that pass every check."""
    return judged.where(F.col("_whole") & F.col("_known")).drop("_before", "_whole", "_known")


def clean_customers(customers: DataFrame) -> DataFrame:
    """Dedup on id (first by the remaining columns), tenure >= 0, trimmed text."""
    out = keep_first(customers, "customer_id", ["segment", "region", "tenure_days", "account_tier"])
    return out.withColumns({
        "tenure_days": clip("tenure_days", 0),
        "segment": F.trim("segment"),
        "region": F.trim("region"),
    })


def clean_products(products: DataFrame) -> DataFrame:
    """Dedup on id, base price >= 0.01, margin in [0, 1]."""
    out = keep_first(products, "product_id", ["category", "base_price", "margin_pct", "is_recurring"])
    return out.withColumns({
        "base_price": clip("base_price", 0.01),
        "margin_pct": clip("margin_pct", 0.0, 1.0),
    })


def clean_all(customers: DataFrame, products: DataFrame, txn: DataFrame,
              order_cols: Sequence[str] = ("part_key", "supp_key"), cap_q: float = 0.995, staged: Staged | None = None):
    """Cleaned customers, products and transactions, one lazy plan unless ``staged`` writes what decides about rows."""
    c = clean_customers(customers)
    p = clean_products(products)
    return c, p, accepted(judged_transactions(typed_transactions(txn, order_cols, staged), c, p, cap_q, staged))


def audit_row(spark: SparkSession, counts: Mapping[str, float]) -> DataFrame:
    """One row with the rows that each step removed and the revenue mean
    before and after capping, of what ``TYPED_COUNTS`` and ``JUDGED_COUNTS``
    counted."""
    def n(name):
        return F.lit(int(counts[name] or 0)).cast("long")

    def mean(name):
        return round_half_up(F.lit(counts[name]).cast("double"), 2)

    return spark.range(1).select(
        n("rows_in").alias("rows_in"),
        (n("rows_in") - n("rows_deduped")).alias("removed_duplicates"),
        (n("rows_deduped") - n("rows_positive")).alias("removed_non_positive"),
        (n("rows_positive") - n("rows_non_null")).alias("removed_null_critical"),
        (n("rows_non_null") - n("rows_out")).alias("removed_orphans"),
        n("rows_out").alias("rows_out"), n("unparsable_quantity").alias("unparsable_quantity"),
        n("discount_at_cap").alias("discount_at_cap"),
        mean("mean_revenue_before_cap").alias("mean_revenue_before_cap"),
        mean("mean_revenue_after_cap").alias("mean_revenue_after_cap"))


def dirty_transactions(txn: DataFrame, orphan_ref: str = "ORPHAN") -> DataFrame:
    """Deterministic dirty variant of the fact (see FIXTURES.md section 3):
    orders loaded twice, text quantities with 'n/a', sign-flipped revenue,
    discounts x10 and customer references missing from the customer dimension."""
    ok = F.col("order_key")
    copies = F.when(ok % 71 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return txn.withColumn("_copy", F.explode(copies)).withColumns({
        "quantity": F.when(ok % 97 == 0, F.lit("n/a")).otherwise(F.col("quantity").cast("string")),
        "revenue": F.when(ok % 89 == 0, -F.col("revenue")).otherwise(F.col("revenue")),
        "discount_pct": F.when(ok % 83 == 0, F.col("discount_pct") * 10).otherwise(F.col("discount_pct")),
        "customer_id": F.when(ok % 79 == 0, pseudonym(F.lit(orphan_ref))).otherwise(F.col("customer_id")),
    }).select(*TRANSACTION_COLUMNS, *HELPER_COLUMNS, *[c for c in (MONTH,) if c in txn.columns])
