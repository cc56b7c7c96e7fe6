"""Ridge regression from sums of outer products, for any number of groups at once.

All that a least-squares fit needs of its rows is the sum of the outer products
of (1, x_1, ..., x_k, y).  Tasks sum them for the groups that they see (one
matrix product a group and batch), an aggregate adds the sums up, and the
small systems are solved in batches.  So a group's rows never meet in one
place, sums of parts can be added to sums of wholes, and a group costs the
same however many rows it has.

Sums are kept as the upper triangle of the matrix, row by row.  Rows with a
null in any column, or in the target, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose sums a task holds before it passes them on.
HELD_GROUPS = 512
#: Systems solved at once.
SOLVED_AT_ONCE = 256


def triangle_size(k: int) -> int:
    """Numbers kept for ``k`` columns, besides the constant and the target."""
    return (k + 2) * (k + 3) // 2


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def gram_sums(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """keys, place and value: the sums of each group, one number a row."""
    keys, p = list(keys), len(xs) + 2
    rows = df.select(*keys, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]).alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull()))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        upper = np.triu_indices(p)
        held: dict[tuple, object] = {}

        def made():
            parts = [[k[i] for k in held] for i in range(len(keys))]
            types = [schema.field(c).type for c in keys]
            out = pa.RecordBatch.from_arrays(
                [*[pa.array(v, t) for v, t in zip(parts, types)],
                 pa.array([m[upper] for m in held.values()], pa.list_(pa.float64()))], [*keys, "sums"])
            held.clear()
            return out

        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            code = np.zeros(len(m), dtype=np.int64)
            for c in keys:
                d = batch.column(c).dictionary_encode()
                n = len(d.dictionary)
                code = code * (n + 1) + pc.fill_null(d.indices, n).to_numpy(zero_copy_only=False)
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            m = m[np.argsort(group, kind="stable")]
            ends = np.cumsum(np.bincount(group))
            names = list(zip(*[batch.column(c).take(pa.array(first)).to_pylist() for c in keys]))
            for name, a, b in zip(names, [0, *ends], ends):
                part = m[a:b].T @ m[a:b]
                held[name] = held[name] + part if name in held else part
            if len(held) >= HELD_GROUPS:
                yield made()
        if held:
            yield made()

    summed = rows.mapInArrow(run, f"{_types(rows, keys)}, sums array<double>")
    return (summed.select(*keys, F.posexplode("sums").alias("place", "value"))
            .groupBy(*keys, "place").agg(F.sum("value").alias("value")))


def running_sums(sums: DataFrame, groups: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """For each row of ``groups`` (by, order) the sums of all groups of ``by`` with this ``order`` or a later one."""
    places = F.explode(F.sequence(F.lit(0), F.lit(triangle_size(k) - 1))).alias("place")
    every = groups.select(*by, order, places).withColumn("value", F.lit(0.0))
    both = sums.select(*by, order, "place", "value").unionByName(every)
    one = both.groupBy(*by, order, "place").agg(F.sum("value").alias("value"))
    w = (Window.partitionBy(*by, "place").orderBy(F.col(order).desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumn("value", F.sum("value").over(w))


def solve(sums: DataFrame, keys: Sequence[str], k: int, alpha: float = 1.0, standardise: bool = False) -> DataFrame:
    """keys, n, coef (of the ``k`` columns) and intercept of each group.

    Ridge with ``alpha`` on the centred columns, the intercept unpenalised;
    with ``standardise`` on columns divided by their population deviation
    (constant ones get no weight).  Coefficients are those of the columns as
    they were given.
    """
    keys, p = list(keys), k + 2
    whole = (sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
             .select(*keys, F.transform("s", lambda x: x["value"]).alias("sums")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        upper = np.triu_indices(p)
        for batch in batches:
            for start in range(0, batch.num_rows, SOLVED_AT_ONCE):
                part = batch.slice(start, SOLVED_AT_ONCE)
                flat = part.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                g = np.zeros((part.num_rows, p, p))
                g[:, upper[0], upper[1]] = flat
                g[:, upper[1], upper[0]] = flat
                n = np.maximum(g[:, 0, 0], 1.0)
                mean, y_mean = g[:, 0, 1:-1] / n[:, None], g[:, 0, -1] / n
                centred = g[:, 1:-1, 1:-1] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
                target = g[:, 1:-1, -1] - (n * y_mean)[:, None] * mean
                spread = np.diagonal(centred, axis1=1, axis2=2)
                varies = spread > 1e-12 * np.diagonal(g[:, 1:-1, 1:-1], axis1=1, axis2=2)
                scale = np.where(varies, np.sqrt(np.maximum(spread, 0) / n[:, None]), 1.0) if standardise else np.ones_like(spread)
                used = varies if standardise else np.ones_like(varies)
                centred = centred / (scale[:, :, None] * scale[:, None, :]) * (used[:, :, None] & used[:, None, :])
                target = target / scale * used
                beta = np.linalg.solve(centred + alpha * np.eye(k), target[:, :, None])[:, :, 0] / scale
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keys], pa.array(g[:, 0, 0].astype(np.int64)),
                     pa.array(list(beta), pa.list_(pa.float64())), pa.array(y_mean - (beta * mean).sum(axis=1))],
                    [*keys, "n", "coef", "intercept"])
    return whole.mapInArrow(run, f"{_types(whole, keys)}, n long, coef array<double>, intercept double")


def linear(xs: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> F.Column:
    """intercept + x'coef of a row."""
    products = F.zip_with(F.array(*[F.col(c).cast("double") for c in xs]), F.col(coef), lambda x, b: x * b)
    return F.col(intercept) + F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
