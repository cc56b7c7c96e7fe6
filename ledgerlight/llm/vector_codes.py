"""Vectors compressed to codes of their parts by member-resident Lloyd iterations.

Vectors of integers are cut into equal parts.  Each position has a codebook of
at most 256 entries, and a part's code is its nearest entry.  A part is a
member of its entry and lives with the other members: member rows are
partitioned by (position, entry, salt) into files of the shared folder, and
salts split an entry that many parts have, such as that of one common vector.

A round has three jobs.  Owners sum the members they hold, so a task gives one
sum for each entry it has some of, and only these meet in an aggregate.  The
new codebook, bounded by parts x entries x width, is given to all tasks.  Each
task finds the nearest entries of its members and writes those that stay where
they are, without a shuffle; only parts that change their entry go through
the next shuffle to their new owners.  Two folders alternate and overwrite each
other, so no more than two generations of members exist.

Numbers are exact: products are taken in doubles while they are integers below
2^53, in 64-bit integers otherwise.  Sums of owners meet as decimals.

Defined cases: rows whose vector is null or empty, has another length than that
of the smallest kept id, or holds a null or non-finite component are dropped.  Rows
that repeat an id each have a code; of equal ids the smaller vector starts a
codebook first; null ids come last.  A table without vectors gives an empty
result.  Extra columns are carried if named, whatever their names.  A vector
length that isn't a multiple of the parts, and components of 2^28 or more after
scaling, whose errors would not fit 64 bits, are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import run_folder, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Owners for each shuffle partition, if their entries have members enough.
OWNERS_PER_PARTITION = 4
LARGEST = 1 << 28
#: Rows whose distances to a codebook are held at a time.
BLOCK = 4096
LABEL_SALTS = 16


def nearest(parts, book):
    """The nearest entry (ties: the first) of each part, and its squared distance."""
    import numpy as np

    entry = np.zeros(len(parts), dtype=np.int64)
    error = np.zeros(len(parts), dtype=np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact_in_doubles = 4 * largest * largest * max(parts.shape[1], 1) < 1 << 53
    for start in range(0, len(parts), BLOCK if exact_in_doubles else BLOCK // 64):
        some = slice(start, start + (BLOCK if exact_in_doubles else BLOCK // 64))
        if exact_in_doubles:
            x, c = parts[some].astype(np.float64), book.astype(np.float64)
            far = (c * c).sum(axis=1) - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
        else:
            far = ((parts[some][:, None, :] - book[None]) ** 2).sum(axis=2)
        entry[some] = far.argmin(axis=1)
        error[some] = far.min(axis=1).astype(np.int64)
    return entry, error


def _matrix(lists):
    """A matrix of an Arrow column of lists of one length."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def _lists(matrix):
    import numpy as np
    import pyarrow as pa

    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width),
                                    pa.array(matrix.astype(np.int32).ravel()))


def scaled(vectors, scale: int):
    """floor(scale * x) as integers."""
    import numpy as np

    out = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError(f"components must be below {LARGEST} after scaling")
    return out.astype(np.int64)


def _assigned(books, salts) -> Callable:
    """(entry, salt, error) of parts at their positions."""
    import numpy as np

    def run(rows, position, parts):
        entry, error = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for p, book in enumerate(books):
            here = np.flatnonzero(position == p)
            entry[here], error[here] = nearest(parts[here], book)
        return entry, rows % salts[position, entry], error
    return run


@dataclass
class Codes:
    """``rows`` has row, the carried columns, code and error; ``books`` an integer matrix for each position."""
    rows: DataFrame
    books: list

    @property
    def books_sha256(self) -> str:
        numbers = ",".join(str(v) for book in self.books for v in book.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: list[str] | None = None,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all rows with a whole vector: one byte a part, as two hex digits."""
    import numpy as np

    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("a code has one byte for each of its parts")
    spark = rows.sparkSession
    carry = [id_col] if carry is None else carry
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.coalesce(finite & (F.size(vector) > 0), F.lit(False))
    kept = rows.where(whole).select(F.struct(*[F.col(c) for c in carry]).alias("carried"),
                                    F.col(id_col).alias("id"), vector.alias("vector"))
    carried_type = kept.schema["carried"].dataType.simpleString()
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(1).collect()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema["carried"].dataType.fields)
    if not first:
        empty = spark.createDataFrame([], f"row long, {names}, code string, error long")
        return Codes(empty, [np.zeros((0, 0), dtype=np.int64)] * parts)
    length = len(first[0]["vector"])
    if length % parts or not length:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} parts")
    kept = kept.where(F.size("vector") == length)
    starts = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.split(scaled(np.array([r["vector"] for r in starts]), scale), parts, axis=1)
    folder = run_folder(spark, "vector-codes")
    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "carried", "vector")

    member_type = (f"row long, carried {carried_type}, position int, entry int, salt int, moved boolean, "
                   "part array<int>")

    def cut(batches: Iterator, assign: Callable) -> Iterator:
        """Members with their first entries."""
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            matrix = scaled(_matrix(batch.column("vector")), scale)
            split = np.concatenate(np.split(matrix, parts, axis=1))
            row = np.tile(batch.column("row").to_numpy(zero_copy_only=False), parts)
            position = np.repeat(np.arange(parts), n)
            entry, salt, _ = assign(row, position, split)
            # what is carried goes with the first part only
            origin = pa.array(np.tile(np.arange(n), parts), mask=position > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), batch.column("carried").take(origin), pa.array(position, pa.int32()),
                 pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), pa.array(np.ones(len(row), dtype=bool)),
                 _lists(split)], ["row", "carried", "position", "entry", "salt", "moved", "part"])

    def again(batches: Iterator, assign: Callable) -> Iterator:
        """Members with their next entries; those that keep their entry keep their place."""
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            row, position, entry, salt = (batch.column(c).to_numpy(zero_copy_only=False)
                                          for c in ("row", "position", "entry", "salt"))
            now, now_salt, _ = assign(row, position, _matrix(batch.column("part")).astype(np.int64))
            moved = now != entry
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("carried"), batch.column("position"), pa.array(now, pa.int32()),
                 pa.array(np.where(moved, now_salt, salt), pa.int32()), pa.array(moved), batch.column("part")],
                ["row", "carried", "position", "entry", "salt", "moved", "part"])

    def sums(batches: Iterator) -> Iterator:
        """The number and the sum of the members of each entry that this task holds."""
        import pyarrow as pa

        width = length // parts
        count = np.zeros(parts * entries, dtype=np.int64)
        total = np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            owner = (batch.column("position").to_numpy(zero_copy_only=False).astype(np.int64) * entries
                     + batch.column("entry").to_numpy(zero_copy_only=False))
            order = np.argsort(owner, kind="stable")
            held, begins = np.unique(owner[order], return_index=True)
            if len(held):
                count += np.bincount(owner, minlength=len(count))
                total[held] += np.add.reduceat(_matrix(batch.column("part"))[order].astype(np.int64), begins, axis=0)
        held = np.flatnonzero(count)
        # the count stands behind the sums
        values = np.column_stack([total[held], count[held]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held // entries, pa.int32()), pa.array(held % entries, pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * (width + 1)),
                                      pa.array(values.ravel()))], ["position", "entry", "sums"])

    def summed(members: DataFrame) -> dict[tuple[int, int], list[int]]:
        """Sums and count of each entry with members; as many rows as the codebooks have numbers, at most."""
        held = members.select("position", "entry", "part").mapInArrow(
            sums, "position int, entry int, sums array<long>")
        each = held.select("position", "entry", F.posexplode("sums").alias("place", "value"))
        found: dict[tuple[int, int], list[int]] = {}
        for r in each.groupBy("position", "entry", "place").agg(
                F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            found.setdefault((r["position"], r["entry"]), [0] * (length // parts + 1))[r["place"]] = int(r["value"])
        return found

    def salts_of(counts: dict[tuple[int, int], int]):
        """Into how many owners the members of each entry are split."""
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        share = max(1, sum(counts.values()) // (OWNERS_PER_PARTITION * partitions))
        out = np.ones((parts, entries), dtype=np.int64)
        for key, n in counts.items():
            out[key] = -(-n // share)
        return out

    def write(members: DataFrame, name: str, *by: str) -> DataFrame:
        members.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(member_type).parquet(f"{folder}/{name}")

    def settled(moving: DataFrame, name: str) -> DataFrame:
        """Members that changed their entry, with their new owners."""
        return write(moving.repartition("position", "entry", "salt"), name)

    assign = _assigned(books, np.ones((parts, entries), dtype=np.int64))
    held = numbered.mapInArrow(lambda b: cut(b, assign), member_type)
    counts = {(r["position"], r["entry"]): r["n"]
              for r in held.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n")).collect()}
    assign = _assigned(books, salts_of(counts))
    members = settled(numbered.mapInArrow(lambda b, a=assign: cut(b, a), member_type), "arrived-0")
    for r in range(1, rounds + 1):
        found = summed(members)
        books = [book.copy() for book in books]
        for (p, e), (*total, n) in found.items():
            books[p][e] = [v // n for v in total]  # floors, for negative sums too
        if r < rounds:
            assign = _assigned(books, salts_of({key: v[-1] for key, v in found.items()}))
            judged = write(members.mapInArrow(lambda b, a=assign: again(b, a), member_type), f"judged-{r % 2}", "moved")
            members = judged.where(~F.col("moved")).unionByName(
                settled(judged.where("moved"), f"arrived-{r % 2}"))

    def errors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        assign = _assigned(books, np.ones((parts, entries), dtype=np.int64))
        for batch in batches:
            entry, _, error = assign(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "position")),
                                     _matrix(batch.column("part")).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("carried"), batch.column("position"), pa.array(entry, pa.int32()),
                 pa.array(error, pa.int64())], ["row", "carried", "position", "entry", "error"])

    final = members.mapInArrow(errors, f"row long, carried {carried_type}, position int, entry int, error long")
    digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    coded = final.groupBy("row").agg(
        F.first("carried", ignorenulls=True).alias("carried"),
        *[F.max(F.when(F.col("position") == p, digits)).alias(f"digits_{p}") for p in range(parts)],
        F.sum("error").alias("error"))
    coded = coded.select("row", "carried.*", F.concat(*[f"digits_{p}" for p in range(parts)]).alias("code"), "error")
    return Codes(coded, books)


def with_group_errors(coded: DataFrame, group_col: str) -> DataFrame:
    """Adds label_error, the summed error of the rows with an equal ``group_col``, nulls together.

    Rows are dealt by (group, row modulo LABEL_SALTS), so that a common group
    is not met in one task; the sums, one for each group, are repeated.
    """
    per_group = coded.groupBy(F.col(group_col).alias("its_group")).agg(F.sum("error").alias("label_error"))
    per_group = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    rows = coded.withColumn("its_salt", (F.col("row") % LABEL_SALTS).cast("int"))
    same = rows[group_col].eqNullSafe(per_group["its_group"]) & (rows["its_salt"] == per_group["salt"])
    return rows.join(per_group, same).drop("its_group", "its_salt", "salt")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    codes = compress(rows, carry=["vec_id", "label"])
    found = with_group_errors(staged(codes.rows, "codes"), "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(codes.books_sha256).alias("codebooks_sha256"))


def _twin() -> str:
    """The same iterations as joins of parts and entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM kept, range({PARTS}) AS r(p)),
book_0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, x AS c FROM part WHERE rid <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
near_{r} AS MATERIALIZED (
  SELECT rid, p, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT
                     * {ENTRIES} + entry) AS best
  FROM part JOIN book_{r} USING (p) GROUP BY rid, p)""")
        if r < ROUNDS:
            steps.append(f"""
mean_{r} AS MATERIALIZED (
  SELECT p, entry, list(m ORDER BY i) AS c FROM (
    SELECT p, best % {ENTRIES} AS entry, i, floor(sum(value) / count(*)) AS m FROM (
      SELECT n.p, n.best, unnest(x) AS value, generate_subscripts(x, 1) AS i
      FROM near_{r} n JOIN part USING (rid, p)) GROUP BY ALL) GROUP BY p, entry),
book_{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book_{r} b LEFT JOIN mean_{r} m USING (p, entry))""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code,
         sum(best // {ENTRIES})::BIGINT AS error
  FROM near_{ROUNDS} GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, entry)) AS d
  FROM book_{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256
FROM coded JOIN kept USING (rid), digest"""


OP12_SQL = _twin()
