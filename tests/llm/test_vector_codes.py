import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from ledgerlight.llm import vector_codes as V

SF_SMALL = "/root/testdata/sf0.001"


def plain(rows, parts=4, entries=256, rounds=4):
    """Lloyd's iterations with Python integers: {position of the row: (code, error)}, digest of the codebooks."""
    kept = [(i, k, v) for i, (k, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    kept = [(i, k, [math.floor(1024 * x) for x in v]) for i, k, v in kept if len(v) == len(order[0][2])]
    order = [v for _, _, v in sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))]
    width = len(order[0]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for v in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, _, v in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(members, books[p])]
    out = {}
    for i, _, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return out, digest


def vectors(rng, n, width, spread=1.0):
    return [[rng.gauss(0, spread) for _ in range(width)] for _ in range(n)]


def compare(spark, rows, **options):
    df = spark.createDataFrame([(k, v, i, "x", 1) for i, (k, v) in enumerate(rows)],
                               "vec_id long, embedding array<double>, `position` long, entry string, `row` int").repartition(5)
    codes = V.compress(df.withColumnRenamed("row", "salt"), carry=["position"], **options)
    want, digest = plain(rows, **options)
    assert {r.position: (r.code, r.error) for r in codes.rows.collect()} == want
    assert codes.books_sha256 == digest
    return codes


def test_like_plain_loops(spark):
    rng = random.Random(1)
    rows = [(i, v) for i, v in enumerate(vectors(rng, 300, 8))]
    rng.shuffle(rows)
    compare(spark, rows)
    compare(spark, rows, entries=7, rounds=6)
    compare(spark, rows, parts=2, entries=16, rounds=1)


def test_dropped_repeated_and_tied(spark):
    rng = random.Random(2)
    common = [0.25, -0.5, 0.125, 1.0]
    rows = [(i, v) for i, v in enumerate(vectors(rng, 40, 4))]
    rows += [(100 + i, common) for i in range(60)]  # one common vector
    rows += [(5, v) for v in vectors(rng, 3, 4)] + [(None, v) for v in vectors(rng, 4, 4)]
    rows += [(-1, None), (-5, []), (-2, [0.0, None, 1.0, 1.0]), (-3, [math.nan] * 4), (-4, [0.0, math.inf, 0.0, 0.0]), (900, [1.0] * 8),
             (901, []), (902, [0.0, -math.inf, 0.0, 0.0])]
    rows += [(i, [float(i % 3), 0.0, 0.0, -1e-9]) for i in range(200, 240)]  # ties
    compare(spark, rows, entries=20, rounds=3)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    compare(spark, [(i, v) for i, v in enumerate(vectors(rng, 30, 4, spread=5e4))], entries=5)
    with pytest.raises(Exception, match="must be below"):
        V.compress(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"))


def test_empty_and_refused(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)]):
        codes = V.compress(spark.createDataFrame(rows, schema), carry=["vec_id", "label"])
        assert V.with_group_errors(codes.rows, "label").collect() == []
    with pytest.raises(ValueError, match="can't be cut"):
        V.compress(spark.createDataFrame([(1, [1.0] * 5, 0)], schema))
    with pytest.raises(ValueError, match="one byte"):
        V.compress(spark.createDataFrame([(1, [1.0] * 4, 0)], schema), entries=257)


def test_label_errors_with_nulls(spark):
    rng = random.Random(4)
    rows = [(i, v, rng.choice([None, 1, 2])) for i, v in enumerate(vectors(rng, 90, 4))]
    codes = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"),
                       carry=["vec_id", "label"], entries=9)
    got = V.with_group_errors(codes.rows, "label").collect()
    assert len(got) == 90
    for r in got:
        assert r.label_error == sum(x.error for x in got if x.label == r.label)


def test_only_moved_members_are_shuffled(spark, monkeypatch):
    """After the first deal, the owners' files that stay are written without an exchange."""
    plans = []
    real = type(spark.range(0)).mapInArrow

    def seen(self, fn, schema, *a, **k):
        out = real(self, fn, schema, *a, **k)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", seen)
    rng = random.Random(5)
    rows = [(i, v) for i, v in enumerate(vectors(rng, 200, 8))]
    V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), entries=16)
    assert len(plans) > 8 and not any("Exchange" in p for p in plans)


def test_query_and_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    want = sorted(map(str, con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({V.OP12_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in V.op12_vector_codes(spark, SF_SMALL).collect()) == want
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert plain(rows)[1] in want[0]


def test_nearest_takes_the_first_of_ties():
    book = np.array([[3, 3], [1, 1], [1, 1], [-1, -1]])
    entry, error = V.nearest(np.array([[1, 1], [0, 0], [2, 2]]), book)
    assert entry.tolist() == [1, 1, 0] and error.tolist() == [0, 2, 2]
