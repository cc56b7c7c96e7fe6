"""Run a registered Spark query and its DuckDB twin side by side and compare.

Usage:  python tests/oracle_compare.py [sf_dir] [name ...]

Checks row count, column names, and values (order-insensitive).  Values are
compared exactly after normalising dates to ISO text; floats also get a
relative-tolerance check so a near miss is reported as such.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, (dt.datetime,)):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) if not isinstance(x, (int, float)) else (2, float(x))
                 for x in row)


def compare_frames(spark_rows, spark_cols, duck_rows, duck_cols):
    out = {"rows_spark": len(spark_rows), "rows_duck": len(duck_rows)}
    out["cols_match"] = sorted(spark_cols) == sorted(duck_cols)
    if not out["cols_match"]:
        out["cols_spark"] = sorted(spark_cols)
        out["cols_duck"] = sorted(duck_cols)
        out["exact"] = out["close"] = False
        return out
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    out["exact"] = a == b
    close = len(a) == len(b)
    first_diff = None
    if close:
        for ra, rb in zip(a, b):
            for c, x, y in zip(order, ra, rb):
                same = x == y
                if not same and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                    same = math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9)
                if not same:
                    close = False
                    first_diff = (c, x, y, ra, rb)
                    break
            if not close:
                break
    out["close"] = close
    if first_diff:
        out["first_diff"] = first_diff
    return out


def run(sf_dir: str, names=None):
    from __spark_entry__ import oracle_sql, queries
    from ledgerlight.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            cols = sdf.columns
            rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"error": f"spark: {type(e).__name__}: {str(e)[:400]}"}
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = {"rows_spark": len(rows), "oracle": "none", "spark_s": round(t1 - t0, 2)}
            print(name, results[name], flush=True)
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows = [tuple(r) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"error": f"duck: {type(e).__name__}: {str(e)[:400]}"}
            print(name, results[name], flush=True)
            continue
        res = compare_frames(rows, cols, drows, dcols)
        res["spark_s"] = round(t1 - t0, 2)
        results[name] = res
        print(name, res, flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
