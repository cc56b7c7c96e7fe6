"""Every registered query against its DuckDB twin on sf0.001 (the driver
checks sf0.01 the same way)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF_SMALL

import __spark_entry__ as E
from ledgerlight.plans import registry
from oracle_compare import compare_frames, duck

QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(df.columns) > 0
        return
    rel = con.execute(ORACLE[name])
    res = compare_frames(rows, df.columns, [tuple(r) for r in rel.fetchall()], [d[0] for d in rel.description])
    assert res["cols_match"], res
    assert res["rows_spark"] == res["rows_duck"], res
    assert res["close"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "revenue" in df.columns
