import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators.daily import aggregate_daily
from ledgerlight.operators.ingest import assert_columns, assert_no_orphans
from ledgerlight.plans.pipeline import Params, csv_clean_fact, csv_star
from ledgerlight.sources.io import (MALFORMED, MONTH, between, load_gbt_model, read_metrics_json, read_raw_csv,
                                    save_model, write_months, write_report_json)
from ledgerlight.streaming.daily_stream import stream_daily


def run_once(spark, source_dir, schema, checkpoint, query_name, series_col=None):
    """Everything available, once, into a table in memory."""
    q = (stream_daily(spark, source_dir, schema, series_col).writeStream
         .outputMode("update").format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(query_name)


HEADER = ("Row ID,Order ID,Order Date,Ship Date,Customer ID,Customer Name,Segment,State/Province,"
          "Product ID,Category,Sales,Profit,Discount,Quantity\n")
LINES = [
    "1,O-1,11/8/2023,11/11/2023,C-1,Jos\xe9,Consumer,Qu\xe9bec,P-1,Furniture,261.96,41.91,0,2",
    "2,O-2,bad,11/11/2023,C-2,Ann,Corporate,Ohio,P-2,Technology,10.0,1.0,0.2,1",
    "1234567,O-3,11/8/2023,11/11/2023,C-1,Jos\xe9,Home Office,Ohio,P-2,Technology,38.04,-1.5,0.2,3",
    ",O-4,12/1/2023,12/2/2023,C-2,Ann,Corporate,Ohio,P-1,Other,20.0,5.0,0.9,4",
    "5,O-5,12/1/2023,12/2/2023,C-2,Ann,Corporate,Ohio,P-1,Furniture,-7.0,5.0,0,1",
]


def _csv(lines):
    p = os.path.join(tempfile.mkdtemp(prefix="ll-csv-"), "raw.csv")
    with open(p, "w", encoding="latin-1") as f:
        f.write(HEADER + "\n".join(lines) + "\n")
    return p


def test_raw_csv_latin1_and_dates(spark):
    rows = read_raw_csv(spark, _csv(LINES)).orderBy("Row ID").collect()
    by_id = {r["Row ID"]: r for r in rows}
    assert by_id[1]["Order Date"] == dt.date(2023, 11, 8) and by_id[1]["Customer Name"] == "Jos\xe9"
    assert by_id[2]["Order Date"] is None and by_id[2][MALFORMED] is None
    assert [r["Row ID"] for r in sorted(rows, key=lambda r: r["_place"])] == [1, 2, 1234567, None, 5]


def test_csv_to_star_and_daily_series(spark):
    p = _csv(LINES)
    params = Params(recurring_category="Technology", min_customers=3, cap_q=1.0)
    customers, products, txn, malformed = csv_star(spark, p, params)
    assert malformed.count() == 0 and txn.count() == 5
    got = {r.transaction_id: r for r in txn.collect()}
    numbered = {"TXN_SS_000001", "TXN_SS_000002", "TXN_SS_1234567", "TXN_SS_000005"}
    assert numbered < set(got)  # and one named by its place in the file
    (unnumbered,) = set(got) - numbered
    assert got["TXN_SS_000001"].region == "Qu\xe9bec" and got["TXN_SS_1234567"].segment == "Consumer"  # the first of C-1
    assert got[unnumbered].category == "Other" and got["TXN_SS_1234567"].is_recurring
    assert {r.product_id: r.category for r in products.collect()} == {"P-1": "Furniture", "P-2": "Technology"}
    daily = {r.date: r for r in aggregate_daily(csv_clean_fact(spark, p, params)).collect()}
    assert set(daily) == {dt.date(2023, 11, 8), dt.date(2023, 12, 1)}
    assert daily[dt.date(2023, 11, 8)].revenue == 300.0 and daily[dt.date(2023, 11, 8)].n_customers == 1
    assert daily[dt.date(2023, 12, 1)].revenue == 20.0 and daily[dt.date(2023, 12, 1)].avg_discount == 0.5


def test_malformed_lines_are_refused_or_set_aside(spark):
    bad = ["six,O-6,12/1/2023,12/2/2023,C-2,Ann,Corporate,Ohio,P-1,Furniture,7.0,5.0,0,1", "7,O-7,12/1/2023"]
    p = _csv(LINES + bad)
    with pytest.raises(ValueError, match="2 lines"):
        csv_star(spark, p)
    *_, txn, malformed = csv_star(spark, p, max_malformed=2)
    assert txn.count() == 5 and {r[MALFORMED] for r in malformed.collect()} == set(bad)


def test_missing_columns_and_orphans_are_errors(spark):
    df = spark.createDataFrame([("t", "c", "p")], "transaction_id string, customer_id string, product_id string")
    with pytest.raises(AssertionError, match="revenue"):
        assert_columns(df, ["revenue", "customer_id"])
    with pytest.raises(AssertionError, match="products 1"):
        assert_no_orphans(df, df.select("customer_id"), df.select("product_id").limit(0))


def test_months_are_replaced_and_pruned(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-months-"), "fact")
    rows = [(dt.date(2024, m, d), float(m * 100 + d)) for m in range(1, 7) for d in (1, 15, 28)]
    write_months(spark.createDataFrame(rows, "date date, revenue double"), path)
    write_months(spark.createDataFrame([(dt.date(2024, 3, 9), 1.0)], "date date, revenue double"), path)
    got = spark.read.parquet(path)
    want = [r for r in rows if r[0].month != 3] + [(dt.date(2024, 3, 9), 1.0)]
    assert sorted((r.date, r.revenue) for r in got.collect()) == sorted(want)
    some = between(got, dt.date(2024, 3, 5), dt.date(2024, 4, 15))
    assert {r.date for r in some.collect()} == {dt.date(2024, 3, 9), dt.date(2024, 4, 1), dt.date(2024, 4, 15)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert f"{MONTH}" in filters.split("]")[0] and "2024-03-01" in filters.split("]")[0]
    assert len(some.inputFiles()) >= 1 and between(got).count() == len(want)
    plain = spark.createDataFrame(rows, "date date, revenue double")
    assert between(plain, end=dt.date(2024, 1, 15)).count() == 2


def test_json_report_and_model_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ll-io-")
    m = spark.createDataFrame([("total", "a", 1.0, 2.0, 3.0, 0.5)],
                              "series_key string, model string, holdout_rmse double, holdout_mae double, "
                              "holdout_mape double, weight double")
    write_report_json(m, os.path.join(d, "metrics"))
    back = read_metrics_json(spark, os.path.join(d, "metrics")).first()
    assert back.weight == 0.5

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("revenue")))
    model = GBTRegressor(labelCol="revenue", maxIter=3, seed=1).fit(train)
    save_model(model, os.path.join(d, "gbt"))
    again = load_gbt_model(os.path.join(d, "gbt"))
    assert again.transform(train).count() == 20


def test_saved_reports_metrics_and_model(spark):
    from conftest import SF_SMALL
    from ledgerlight.plans import registry as R
    for back, source in (("report_json", "eda_report"), ("metrics_json", "ensemble_weights"),
                         ("saved_model_holdout", "tree_holdout")):
        got, want = R.QUERIES[back](spark, SF_SMALL), R.QUERIES[source](spark, SF_SMALL)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_daily_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="ll-stream-")
    src = os.path.join(d, "in")
    df = spark.createDataFrame(
        [("t1", dt.date(2024, 1, 1), "c1", 10.0, 0.1), ("t2", dt.date(2024, 1, 1), "c2", 5.0, 0.0),
         ("t3", dt.date(2024, 1, 2), "c1", 7.0, 0.2)],
        "transaction_id string, date date, customer_id string, revenue double, discount_pct double")
    df.write.parquet(src)
    out = run_once(spark, src, df.schema, os.path.join(d, "ck"), "ll_daily_test")
    got = {r.date: (r.revenue, r.n_transactions) for r in out.collect()}
    assert got == {dt.date(2024, 1, 1): (15.0, 2), dt.date(2024, 1, 2): (7.0, 1)}


def test_stream_matches_batch_daily_on_clean_fact(spark):
    from conftest import SF_SMALL
    from ledgerlight.operators.daily import aggregate_daily
    from ledgerlight.plans.pipeline import clean_star
    fact = clean_star(spark, SF_SMALL)[2].select("transaction_id", "date", "customer_id", "segment",
                                                 "revenue", "discount_pct")
    d = tempfile.mkdtemp(prefix="ll-stream-fact-")
    fact.write.parquet(os.path.join(d, "in"))
    out = run_once(spark, os.path.join(d, "in"), fact.schema, os.path.join(d, "ck"), "ll_daily_seg", "segment")
    got = {(r.series_key, r.date): (round(r.revenue, 2), r.n_transactions) for r in out.collect()}
    want = {(r.series_key, r.date): (r.revenue, r.n_transactions)
            for r in aggregate_daily(fact.withColumn("gross_profit", F.lit(0.0))
                                         .withColumn("product_id", F.lit("p"))
                                         .withColumn("quantity", F.lit(1))
                                         .withColumn("is_recurring", F.lit(False)), "segment").collect()}
    assert got == want
