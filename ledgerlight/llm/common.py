"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import ensure_checkpoint_dir

#: Batches for Python have a bounded size.
_BATCH_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Of stages; and the shuffle files of a written stage go, as nothing reads them again.
_STAGE_CONF = _BATCH_CONF | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def bound_batches(spark: SparkSession) -> None:
    """From now on batches for Python are of a few megabytes in this session, if it has not set a size itself.

    Spark's default is 64 MB, which the executor's JVM and each of its workers
    hold several times over.
    """
    for k, v in _BATCH_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlight-llm/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{folder or run_folder(spark, name)}/{name}"
    before = {k: spark.conf.get(k, None) for k in _STAGE_CONF}
    try:
        for k, v in _STAGE_CONF.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, schema: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of parameters as literals of the plan (no Python row conversion)."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_slices(batches: Iterator, column: str, limit: int) -> Iterator:
    """Arrow batches cut into slices of about ``limit`` bytes of ``column`` (a row is never cut)."""
    import numpy as np

    for batch in batches:
        i = batch.schema.get_field_index(column)
        lens = batch.column(i).nbytes and _lengths(batch.column(i))
        if batch.num_rows == 0:
            yield batch
            continue
        ends = np.cumsum(np.asarray(lens, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(col):
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def labelled_sample(labels: DataFrame, label_col: str, per_class: int, keep: Column | None = None) -> DataFrame:
    """At most ``per_class`` ids of each label 0 and 1, in order of a hash of the id: (doc_id, label, weight).

    ``weight`` times the rows of a class is the class's share of the labelled
    rows.  Rows without id or label are left out; an id with several labels
    counts with its largest.  The result has at most ``2 * per_class`` rows.
    """
    rows = labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    # a bounded heap in each task, then a bounded merge
    picked = [rows.where(F.col("label") == v).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
              .limit(per_class) for v in (0, 1)]
    shares = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return (picked[0].unionByName(picked[1]).join(F.broadcast(shares), "label")
            .select("doc_id", "label", (F.col("n") / F.least(F.col("n"), F.lit(per_class))).alias("weight")))


def groups(batches: Iterator, keys: list[str]) -> Iterator:
    """Arrow tables of the rows of one key each, from batches in which equal keys are neighbours.

    Only for groups of bounded size: one is held at a time.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns))
        cuts = np.flatnonzero([True, *[a != b for a, b in zip(marks[1:], marks)]])
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
            if held and marks[start] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = marks[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield held_key, pa.Table.from_batches(held)


def connected(edges: DataFrame, name: str = "connected") -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node that it reaches.

    Large-star and small-star rounds, each written to the shared folder.  All
    steps are joins and aggregates with map-side combine; a hub's edges are
    never gathered in one place.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return (both.where(F.col("b") > F.col("a")).join(least, "a")
                .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())

    def small(e: DataFrame) -> DataFrame:  # every edge leads to a smaller node
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while (seen := state(now)) != before:
        before = seen
        now = staged(small(stars(now)), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
