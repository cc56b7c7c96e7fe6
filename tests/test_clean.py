from pyspark.sql import functions as F

from ledgerlight.operators.clean import coerce_types, keep_first
from ledgerlight.operators.ingest import tier_from_terciles


def test_keep_first_uses_order(spark):
    df = spark.createDataFrame([("t1", 2, "late"), ("t1", 1, "early"), ("t2", 5, "only")],
                               "transaction_id string, o int, v string")
    got = {r.transaction_id: r.v for r in keep_first(df, "transaction_id", ["o"]).collect()}
    assert got == {"t1": "early", "t2": "only"}


def test_coerce_unparsable_to_null(spark):
    df = spark.createDataFrame([("2024-01-01", "n/a", 1.0, 1.0, 0.1, 1.0), ("2024-01-02", "3", 2.0, 1.0, 0.1, 1.0)],
                               "date string, quantity string, revenue double, unit_price double, "
                               "discount_pct double, gross_profit double")
    out = coerce_types(df).orderBy("date").collect()
    assert out[0].quantity is None and out[1].quantity == 3


def test_tiers_are_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "s double")
    got = [r[0] for r in df.select(tier_from_terciles(F.col("s"), F.lit(2.0), F.lit(3.0))).orderBy("s").collect()]
    assert got == ["Bronze", "Bronze", "Silver", "Gold"]


def _small_star(spark):
    """Ten lines of which one is a copy, one has no number, and others fail one check each."""
    import datetime as dt
    from ledgerlight.operators.ingest import HELPER_COLUMNS, TRANSACTION_COLUMNS
    day = dt.date(2024, 1, 5)
    rows = []
    for i in range(9):
        rows.append([f"t{i}", day, "c1", "p1", "S", "R", "cat", "2", 5.0, 0.1, 10.0 + i, 4.0, 6.0, True, "Gold", i, 1, 1])
    rows.append(list(rows[0]))
    rows[1][7] = "n/a"
    rows[2][10] = -3.0
    rows[3][10] = None
    rows[4][1] = None
    rows[5][2] = "unknown"
    rows[6][3] = "unknown"
    rows[7][9] = 2.5
    rows[8][10] = 1e6
    schema = ("transaction_id string, date date, customer_id string, product_id string, segment string, region string, "
              "category string, quantity string, unit_price double, discount_pct double, revenue double, cost double, "
              "gross_profit double, is_recurring boolean, account_tier string, order_key int, part_key int, supp_key int")
    txn = spark.createDataFrame([tuple(r) for r in rows], schema).select(*TRANSACTION_COLUMNS, *HELPER_COLUMNS)
    customers = spark.createDataFrame([("c1", " S ", "R", -4, "Gold"), ("c1", "T", "R", 4, "Gold")],
                                      "customer_id string, segment string, region string, tenure_days int, account_tier string")
    products = spark.createDataFrame([("p1", "cat", 5.0, 0.5, True)],
                                     "product_id string, category string, base_price double, margin_pct double, is_recurring boolean")
    return customers, products, txn


def _audited(spark, key):
    from ledgerlight.operators import clean as C
    from ledgerlight.plans.stages import Observed, observed_stage
    customers, products, txn = _small_star(spark)
    c, p = C.clean_customers(customers), C.clean_products(products)
    typed, seen = observed_stage(spark, ("typed", key), lambda: Observed(C.typed_transactions(txn), C.TYPED_COUNTS))
    fact, judged = observed_stage(spark, ("fact", key), lambda: Observed(
        C.judged_transactions(typed, c, p, 0.5), C.JUDGED_COUNTS, C.accepted))
    return fact, C.audit_row(spark, seen | judged).first().asDict()


def test_audit_is_counted_while_the_tables_are_written(spark, monkeypatch):
    fact, audit = _audited(spark, "audit-test")
    # positive revenues are 10, 11, 14, 15, 16, 17 and a million; the cap is their median, 15
    assert audit == {
        "rows_in": 10, "removed_duplicates": 1, "removed_non_positive": 1, "removed_null_critical": 2,
        "removed_orphans": 2, "rows_out": 4, "unparsable_quantity": 1, "discount_at_cap": 1,
        "mean_revenue_before_cap": round((10 + 11 + 14 + 15 + 16 + 17 + 1e6) / 7, 2),
        "mean_revenue_after_cap": round((10 + 11 + 14 + 15 + 15 + 15 + 15) / 7, 2)}
    got = {r.transaction_id: r for r in fact.collect()}
    assert set(got) == {"t0", "t1", "t7", "t8"}
    assert got["t1"].quantity is None and got["t7"].discount_pct == 0.5
    assert got["t8"].revenue == got["t7"].revenue == 15.0 and got["t8"].gross_profit == 11.0
    group = "audit-again"
    spark.sparkContext.setJobGroup(group, group)
    assert _audited(spark, "audit-test")[1] == audit
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 1  # the row itself; nothing is counted again
    monkeypatch.setenv("LEDGERLIGHT_MATERIALIZE", "0")
    assert _audited(spark, "audit-lazy")[1] == audit


def test_audit_of_empty_tables(spark):
    from ledgerlight.operators import clean as C
    customers, products, txn = _small_star(spark)
    judged = C.judged_transactions(C.typed_transactions(txn.limit(0)), customers, products)
    counts = judged.selectExpr(*[f"{sql} AS {name}" for name, sql in C.JUDGED_COUNTS.items()]).first().asDict()
    typed = C.typed_transactions(txn.limit(0)).selectExpr(*[f"{q} AS {n}" for n, q in C.TYPED_COUNTS.items()]).first().asDict()
    row = C.audit_row(spark, counts | typed).first()
    assert row.rows_in == row.rows_out == 0 and row.mean_revenue_after_cap is None


def _kept(spark):
    import tempfile
    at = tempfile.mkdtemp()

    def staged(name, build):
        build().write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")
    return staged


def test_staged_cleaning_gives_the_same_rows(spark, monkeypatch):
    from ledgerlight.operators import clean as C
    customers, products, txn = _small_star(spark)
    c, p = C.clean_customers(customers), C.clean_products(products)
    nameless = txn.limit(2).withColumn("transaction_id", F.lit(None).cast("string"))  # two rows share no id
    txn = txn.unionByName(nameless).unionByName(txn.where("transaction_id = 't8'").withColumn("part_key", F.lit(0)))
    typed = sorted(C.typed_transactions(txn).collect(), key=str)
    want = sorted(C.judged_transactions(C.typed_transactions(txn), c, p, 0.5).collect(), key=str)
    assert sum(r["_copies"] for r in typed) == txn.count()
    for limit in (C.HASHES_TO_ALL, 0):
        monkeypatch.setattr(C, "HASHES_TO_ALL", limit)
        staged = _kept(spark)
        mine = C.typed_transactions(txn, staged=staged)
        assert sorted(mine.collect(), key=str) == typed
        assert sorted(C.judged_transactions(mine, c, p, 0.5, staged).collect(), key=str) == want


def test_rows_with_a_key_of_their_own_stay_where_they_are(spark):
    from ledgerlight.operators import clean as C
    customers, products, txn = _small_star(spark)
    staged = _kept(spark)
    mine = C.judged_transactions(C.typed_transactions(txn, staged=staged), customers, products, 0.5, staged)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "transaction_id" in shuffles[0], plan  # the rows whose key comes twice


def test_rows_dealt_by_month_keep_it_unless_a_join_deals_them_anew(spark, monkeypatch):
    """The fact was dealt by month a second time, as whole rows with their ids."""
    from ledgerlight.operators import clean as C
    from ledgerlight.sources.io import MONTH
    customers, products, txn = _small_star(spark)
    staged = _kept(spark)
    want = sorted(C.accepted(C.judged_transactions(C.typed_transactions(txn), customers, products, 0.5)).collect(), key=str)
    for name, few in (("HASHES_TO_ALL", True), ("HASHES_TO_ALL", False), ("KEYS_TO_ALL", False)):
        monkeypatch.undo()
        if not few:
            monkeypatch.setattr(C, name, -1)
        staged = _kept(spark)
        dealt = C.dirty_transactions(txn.withColumn(MONTH, F.trunc("date", "month"))).select(*txn.columns, MONTH)
        assert MONTH in dealt.columns
        rows = txn.withColumn(MONTH, F.trunc("date", "month"))
        mine = C.accepted(C.judged_transactions(C.typed_transactions(rows, staged=staged), customers, products, 0.5, staged))
        assert (MONTH in mine.columns) == few
        assert sorted(mine.drop(MONTH).collect(), key=str) == want
