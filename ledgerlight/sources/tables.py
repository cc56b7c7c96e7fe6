"""Readers for the Parquet tables and the raw flat sales table built from them.

The reference starts from one flat file with one row per order line.  Here
that flat table is a join of ``lineitem``, ``orders``, ``customer``,
``nation`` and ``part``; every later stage reads it lazily, so Catalyst sees
one plan from the Parquet scans to each result and prunes columns and pushes
filters down to the scans.

Join order is chosen for the shuffle it leaves behind: orders are joined to
customers first (orders is a quarter of lineitem), lineitem is joined to that
on the order key, and the join to ``part`` comes last so the flat table is
hash-partitioned by the part key, which the product dimension join reuses.
``nation`` has 25 rows by definition and is the only explicit broadcast; the
other joins are left to AQE, which turns a join into a broadcast join only
when the measured size of a side is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

RAW_COLUMNS = (
    "order_key", "line_number", "part_key", "supp_key", "order_date",
    "customer_key", "customer_name", "segment", "region", "product_key",
    "category", "sales", "cost", "profit", "discount", "quantity",
)


_SCHEMAS: dict[tuple, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; its schema is read from the files once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, in the shape of the reference's raw file.

    sales  = extended price net of discount
    cost   = quantity x list price of the part
    profit = sales - cost
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")

    cust_n = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "inner")
    orders_c = orders.join(cust_n, orders.o_custkey == cust_n.c_custkey, "inner")
    lines = li.join(orders_c, li.l_orderkey == orders_c.o_orderkey, "inner")
    flat = lines.join(part, lines.l_partkey == part.p_partkey, "inner")

    sales = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    return flat.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_key"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("region"),
        F.col("l_partkey").cast("string").alias("product_key"),
        F.col("p_type").alias("category"),
        sales.alias("sales"),
        cost.alias("cost"),
        (sales - cost).alias("profit"),
        F.col("l_discount").alias("discount"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
