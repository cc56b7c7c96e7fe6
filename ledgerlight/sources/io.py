"""File sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

# Columns of the reference's raw sales file, in file order.
RAW_CSV_SCHEMA = StructType([
    StructField("Row ID", LongType()),
    StructField("Order ID", StringType()),
    StructField("Order Date", StringType()),
    StructField("Ship Date", StringType()),
    StructField("Customer ID", StringType()),
    StructField("Customer Name", StringType()),
    StructField("Segment", StringType()),
    StructField("State/Province", StringType()),
    StructField("Product ID", StringType()),
    StructField("Category", StringType()),
    StructField("Sales", DoubleType()),
    StructField("Profit", DoubleType()),
    StructField("Discount", DoubleType()),
    StructField("Quantity", LongType()),
])

REPORT_SCHEMA = "section string, key string, metric string, value double, text string"
METRICS_SCHEMA = ("series_key string, model string, holdout_rmse double, holdout_mae double, "
                  "holdout_mape double, weight double")


#: Of a line that doesn't fit the schema: its text.
MALFORMED = "_malformed"


def read_raw_csv(spark: SparkSession, path: str, schema: StructType = RAW_CSV_SCHEMA) -> DataFrame:
    """Latin-1 CSV with a header, explicit schema, month-first dates
    parsed with ``try_to_date`` (unparsable dates become null, F6).

    ``_malformed`` has the text of a line that doesn't fit the schema, and is
    null elsewhere.  ``_place`` (file, start of the split, row in the task)
    orders the rows of a file as they stand in it; write the result before
    using it, as reading again may split the files differently.
    """
    wide = StructType([*schema.fields, StructField(MALFORMED, StringType())])
    df = (spark.read.schema(wide).option("header", True).option("encoding", "ISO-8859-1")
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).csv(path))
    return df.withColumns({
        "Order Date": F.try_to_date(F.col("Order Date"), "M/d/yyyy"),
        "Ship Date": F.try_to_date(F.col("Ship Date"), "M/d/yyyy"),
        "_place": F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                           F.monotonically_increasing_id().alias("row")),
    })


def raw_from_csv(lines: DataFrame) -> DataFrame:
    """The lines of ``read_raw_csv`` in the shape of the raw sales table.

    ``source_row`` is the file's own row number; ``_place`` keeps the order of
    the file, in which the first value of a customer or product is meant."""
    return lines.where(F.col(MALFORMED).isNull()).select(
        F.col("Row ID").alias("source_row"), "_place",
        F.col("Order ID").alias("order_key"), F.col("Order Date").alias("order_date"),
        F.col("Customer ID").alias("customer_key"), F.col("Customer Name").alias("customer_name"),
        F.col("Segment").alias("segment"), F.col("State/Province").alias("region"),
        F.col("Product ID").alias("product_key"), F.col("Category").alias("category"),
        F.col("Sales").alias("sales"), (F.col("Sales") - F.col("Profit")).alias("cost"),
        F.col("Profit").alias("profit"), F.col("Discount").alias("discount"), F.col("Quantity").alias("quantity"))


#: Lines of a CSV file that is written.
CSV_ROWS = 2_000_000


def write_raw_csv(raw: DataFrame, path: str) -> None:
    """The raw sales table as a latin-1 CSV, gzipped, that ``read_raw_csv`` reads; rows are numbered as they are
    written.  A file, which one task reads, has at most ``CSV_ROWS`` of them."""
    us = lambda c: F.date_format(c, "M/d/yyyy")
    (raw.select(
        F.monotonically_increasing_id().alias("Row ID"), F.col("order_key").alias("Order ID"),
        us("order_date").alias("Order Date"), us("order_date").alias("Ship Date"),
        F.col("customer_key").alias("Customer ID"), F.col("customer_name").alias("Customer Name"),
        F.col("segment").alias("Segment"), F.col("region").alias("State/Province"),
        F.col("product_key").alias("Product ID"), F.col("category").alias("Category"), F.col("sales").alias("Sales"),
        F.col("profit").alias("Profit"), F.col("discount").alias("Discount"), F.col("quantity").alias("Quantity"))
     .write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").option("compression", "gzip")
     .option("maxRecordsPerFile", CSV_ROWS).csv(path))


#: Of the tables that stages write.
COMPRESSION = "zstd"
#: Partition column of facts, the first day of the month (S3).
MONTH = "sale_month"


def by_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows with their month, dealt by it for writing: a month is one file, or several if it is large.

    Rebalancing splits large months and joins small ones by measured size.
    """
    return df.withColumn(MONTH, F.trunc(date_col, "month")).hint("rebalance", MONTH)


def write_months(df: DataFrame, path: str, date_col: str = "date") -> None:
    """S3: a Parquet table with a folder for each month.  Months in ``df``
    replace those in the table; the others stay as they are.  Rows that have
    a month already are written as they are dealt."""
    dealt = df if MONTH in df.columns else by_month(df, date_col)
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION)
     .partitionBy(MONTH).parquet(path))


def between(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None, date_col: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end`` (both included; none is open).  On a
    table with a folder for each month, only the folders needed are read."""
    for bound, inside in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            df = df.where(inside(F.col(date_col), F.lit(bound)))
            if MONTH in df.columns:
                df = df.where(inside(F.col(MONTH), F.lit(bound.replace(day=1))))
    return df


def write_report_json(df: DataFrame, path: str) -> None:
    """JSON lines of a (long-form) report table."""
    df.write.mode("overwrite").json(path)


def read_report_json(spark: SparkSession, path: str) -> DataFrame:
    """A report written by ``write_report_json``."""
    return spark.read.schema(REPORT_SCHEMA).json(path)


def read_metrics_json(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """Metrics written by ``write_report_json``, read with a fixed schema."""
    return spark.read.schema(schema).json(path)


def save_model(model, path: str) -> None:
    """MLlib model save (overwrite)."""
    model.write().overwrite().save(path)


def load_gbt_model(path: str):
    from pyspark.ml.regression import GBTRegressionModel
    return GBTRegressionModel.load(path)
