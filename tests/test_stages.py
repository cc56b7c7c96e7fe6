import datetime as dt
import glob
import tempfile
import time
import uuid

from pyspark.sql import functions as F

from ledgerlight.operators.ingest import build_customers, build_products, build_transactions
from ledgerlight.plans import stages as S
from ledgerlight.plans.pipeline import clean_star, star_full
from ledgerlight.sources.io import MONTH, raw_from_csv, read_raw_csv, write_raw_csv


def _tables(spark, lines=400):
    """Tables of one's own: two orders without a date, a part twice, a line of an unknown order."""
    top = tempfile.mkdtemp(prefix="ll-tables-")
    day = lambda i: None if i in (3, 4) else dt.datetime(1997, 1 + i % 5, 1 + i % 28)
    made = {
        "nation": ([(0, "PERU"), (1, "CHAD")], "n_nationkey long, n_name string"),
        "customer": ([(i, f"C{i}", i % 2, f"S{i % 3}") for i in range(9)],
                     "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "part": ([(i, ["PROMO", "LARGE"][i % 2], 10.0 + i) for i in range(12)] + [(5, "LARGE", 15.0)],
                 "p_partkey long, p_type string, p_retailprice double"),
        "orders": ([(i, i % 9, day(i)) for i in range(80)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(i % 81, i % 12, i % 4, i % 5, float(1 + i % 7), 100.0 + i, 0.01 * (i % 6)) for i in range(lines)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return top


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirs() for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_shuffle_files_of_a_written_stage_go(spark):
    """They stayed until the driver happened to collect its garbage, beside those of all later stages."""
    names = list(S._WRITE_CONF)
    set_before, files = [spark.conf.get(n, None) for n in names], _shuffle_files(spark)
    df = spark.range(2000).groupBy((F.col("id") % 700).alias("k")).count()
    assert S.stage(spark, ("shuffled", uuid.uuid4().hex), lambda: df).count() == 700
    left = lambda: {f for f in _shuffle_files(spark) - files}
    mine = left()
    until = time.time() + 20
    while len(left() & mine) > 1 and time.time() < until:  # the count above left one
        time.sleep(0.2)
    assert len(left() & mine) <= 1, mine
    assert [spark.conf.get(n, None) for n in names] == set_before


def test_settings_hold_while_any_stage_is_written(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    with S.writing(spark):
        with S.writing(spark):
            assert spark.conf.get(name) == S._WRITE_CONF[name]
        assert spark.conf.get(name) == S._WRITE_CONF[name]
    assert spark.conf.get(name, None) == before and not S._WRITING


def test_transactions_lie_by_month_and_the_fact_is_not_dealt_again(spark):
    sf = _tables(spark)
    customers, products, txn = star_full(spark, sf)
    path = next(p for k, (p, *_) in S._TABLES.items() if k[1:3] == ("transactions", sf))
    assert glob.glob(f"{path.removeprefix('file:')}/{MONTH}=1997-01-01/*.zstd.parquet") and MONTH in txn.columns
    raw = next(p for k, (p, *_) in S._TABLES.items() if k[1:3] == ("raw", sf))
    plain = build_transactions(spark.read.parquet(raw), customers, products)
    assert MONTH not in plain.columns and plain.count() > 390
    assert sorted(map(tuple, txn.drop(MONTH).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert txn.where(f"{MONTH} is null").count() == txn.where("date is null").count() > 0
    made = []
    real = S.by_month
    S.by_month = lambda *a: made.append(a) or real(*a)
    try:
        fact, dirty = clean_star(spark, sf)[2], clean_star(spark, sf, dirty=True)[2]
    finally:
        S.by_month = real
    assert not made and fact.where(f"date is null or {MONTH} <> trunc(date, 'month')").count() == 0
    assert 0 < dirty.count() < fact.count() + 20


def test_products_are_joined_before_the_ids_are_there(spark):
    sf = _tables(spark)
    from ledgerlight.sources.tables import raw_sales
    raw = raw_sales(spark, sf)
    seen = []
    build_transactions(raw, build_customers(raw, keep_key=True), build_products(raw), dealt=lambda j: seen.append(j) or j)
    assert "customer_name" not in seen[0].columns and seen[0].columns.index("_rec") < seen[0].columns.index("_cid")


def test_csv_is_gzipped_in_files_of_bounded_rows(spark, monkeypatch):
    from ledgerlight.sources import io
    from ledgerlight.sources.tables import raw_sales
    monkeypatch.setattr(io, "CSV_ROWS", 50)
    raw, path = raw_sales(spark, _tables(spark)).coalesce(1), tempfile.mkdtemp(prefix="ll-gz-")
    write_raw_csv(raw, path)
    files = glob.glob(f"{path}/*.csv.gz")
    assert len(files) == -(-raw.count() // 50)
    got = raw_from_csv(read_raw_csv(spark, path))
    columns = ["order_key", "order_date", "customer_name", "region", "category", "sales", "quantity"]
    same = lambda df: sorted(map(str, df.selectExpr("cast(order_key as string) order_key", *columns[1:]).collect()))
    assert same(got) == same(raw)
