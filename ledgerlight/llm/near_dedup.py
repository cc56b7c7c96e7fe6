"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct shingles (of 3 words, if not told otherwise).  Register i of a set
is the smallest of n exponential variables (one a shingle, from a hash),
truncated to the exponentially spaced values ``b ** -k`` and kept as k: one
byte.  Registers of a union are the larger ones of the parts, and equal
registers are as likely as sets are alike.

1. Documents with equal sets form a class; classes go on (so copies are never
   paired).  One pass over the texts makes sizes, signatures and registers.
2. Classes that agree in all registers of a band share a bucket.  In a bucket,
   two classes stay candidates unless the joint likelihood of their sizes and
   registers speaks against the wanted similarity by far (``SLACK`` in log
   likelihood); the connected candidates form families.  A bucket too large for
   one task keeps all its classes together, which loses nothing.
3. Families are confirmed on full sets: a breadth-first search over an inverted
   index in memory reaches every class that an unreached one links to, without
   listing pairs.  A large family is cut into blocks that share some pivots;
   what is not connected to the family's main component by then is compared
   with every other block.
4. Links are joined to components; the smallest doc_id names one.

A pair of the least wanted similarity shares none of the 32 bands with
probability 5e-8 at 85 %, and 1.4e-5 at 80 %.

Defined cases: null and empty texts, and texts without words, have the empty
set and are linked with nothing, each its own component; texts of fewer words
than a shingle have one, the whole sequence; repeated rows are copies of
each other; a component without any doc_id has a null component_id and keeps
nothing; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import connected, groups, run_folder, staged, text_slices

#: Of op3.
SHINGLE = 3
PERCENT = 85
BASE = 1.2
BAND_ROWS = 6
BANDS = 32
REGISTERS = BAND_ROWS * BANDS
#: Log likelihood by which the best similarity must beat the wanted one to drop a pair (6 standard deviations).
SLACK = 18.0
#: Share of equal registers that makes a pair a candidate at once.
CLEARLY = 0.8
#: Classes, and shingles, of a bucket or block that one task handles at once.
BLOCK = 3000
BLOCK_SHINGLES = 2_000_000
PIVOTS = 64
KEPT_WORDS = 80_000
SLICE_BYTES = 4 << 20

_UPPER_TO_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    mixed = np.full(n, 0x9E3779B97F4A7C15 + width, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i:i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def register_seeds(count: int = REGISTERS):
    import numpy as np

    return np.random.default_rng(20240229).integers(0, 2 ** 32, count, dtype=np.uint32) | np.uint32(1)


def registers(shingles, seeds):
    """One byte a register: the truncated exponential minimum of all shingles, as its exponent."""
    import numpy as np

    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(seeds), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(folded), 256):
        x = folded[start:start + 256, None] * seeds[None, :]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(least, x.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge_registers(a, b):
    """Registers of the union."""
    import numpy as np

    return np.maximum(a, b)


def _chance(x):
    """P(register of one set is larger), x: the other set's share of what only one of them has."""
    import numpy as np

    return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j, n_a, n_b, larger, smaller, equal):
    """Of Jaccard similarity ``j`` given both sizes and how many registers are larger, smaller, equal."""
    import numpy as np

    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    up, down = _chance(u - v * j), _chance(v - u * j)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))


def estimate(n_a, n_b, larger, smaller, equal):
    """Maximum-likelihood similarity on a grid of hundredths, and its log likelihood."""
    import numpy as np

    best, at = None, None
    for step in range(0, 101, 4):
        j = np.minimum(step / 100, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
        value = log_likelihood(j, n_a, n_b, larger, smaller, equal)
        at = j if best is None else np.where(value > best, j, at)
        best = value if best is None else np.maximum(best, value)
    return at, best


def maybe_linked(n_a: int, regs_a, n_b, regs_b, percent: int = PERCENT):
    """Which sets b can be linked with a set a: by size, exactly, and by the registers' likelihood.

    Sets with at least ``CLEARLY`` equal registers stay without asking for the likelihood.
    """
    import numpy as np

    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    equal = (regs_a[None, :] == regs_b).sum(1)
    out = fits & (equal >= CLEARLY * regs_b.shape[1])
    asked = np.flatnonzero(fits & ~out)
    if len(asked):
        n_b, regs_b, equal = n_b[asked].astype(np.float64), regs_b[asked], equal[asked]
        larger = (regs_a[None, :] > regs_b).sum(1)
        smaller = regs_b.shape[1] - larger - equal
        at, best = estimate(float(n_a), n_b, larger, smaller, equal)
        wanted = log_likelihood(percent / 100, float(n_a), n_b, larger, smaller, equal)
        out[asked] = (at >= percent / 100) | (wanted >= best - SLACK)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, signature of the set, registers; the last two null for empty sets."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, seeds = WordHashes(), register_seeds()
        for batch in text_slices(batches, "text", SLICE_BYTES):
            n, signature, regs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes, shingle)
                n.append(len(s))
                signature.append(hashlib.md5(s.tobytes()).hexdigest() if len(s) else None)
                regs.append(registers(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signature, pa.string()),
                 pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "signature", "registers"])
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_shingles long, signature string, "
                                  "registers binary")


def _bucket_families(percent: int):
    """Edges (a, b) that join the classes of a bucket which can be linked; forests, not pairs."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, table in groups(batches, ["band", "bucket"]):
            names = table.column("signature").to_pylist()
            n = table.column("n_shingles").to_numpy()
            regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint8).reshape(len(n), -1)
            edges: list[tuple] = []
            left = np.arange(len(n))
            while len(left) > 1:
                root, left = left[0], left[1:]
                queue = [root]
                while queue and len(left):
                    at = queue.pop()
                    near = maybe_linked(n[at], regs[at], n[left], regs[left], percent)
                    found, left = left[near], left[~near]
                    queue.extend(found)
                    edges.extend((names[f], names[root]) for f in found)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.string()),
                                              pa.array([e[1] for e in edges], pa.string())], ["a", "b"])
    return run


def families(classes: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """(node, root): the family of every class (signature, n_shingles, registers) that has candidates."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.xxhash64(F.substr(F.col("registers"), i * BAND_ROWS + 1, F.lit(BAND_ROWS))).alias("bucket")))
    entries = classes.select("signature", F.explode(bands).alias("e")).select("signature", "e.band", "e.bucket")
    shared = staged(entries.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("signature").alias("leader")).where("size > 1"), "buckets", folder)
    members = staged(entries.join(shared, ["band", "bucket"]), "members", folder)
    large = members.where(F.col("size") > BLOCK).select(F.col("signature").alias("a"), F.col("leader").alias("b"))
    small = members.where(F.col("size") <= BLOCK).select("band", "bucket", "signature").join(
        classes.select("signature", "n_shingles", "registers"), "signature")
    edges = (small.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "signature")
             .mapInArrow(_bucket_families(percent), "a string, b string"))
    return connected(edges.unionByName(large).distinct(), "families")


def _confirm(percent: int):
    """Links (a, b) that connect what the sets of a block connect; classes of one component are not compared."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, table in groups(batches, ["family", "block", "other"]):
            table = table.combine_chunks()
            names = table.column("signature").to_pylist()
            known = table.column("component").to_pylist()
            sets = [np.frombuffer(s, dtype="<u8") for s in table.column("shingles").to_pylist()]
            edges = [(names[i], names[j]) for i, j in search(sets, known, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.string()),
                                              pa.array([e[1] for e in edges], pa.string())], ["a", "b"])
    return run


def search(sets: list, known: list, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets that, with equal ``known`` components, connect all that is connected."""
    import numpy as np

    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sets.clear()  # only their numbers are needed from here on
    bounds = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
    code = {c: i for i, c in enumerate(dict.fromkeys(known))}
    component = np.array([code[c] for c in known])
    waiting = np.ones(count, dtype=bool)
    edges = []

    def index(of):
        order = of[np.argsort(ids[of], kind="stable")]
        starts = np.searchsorted(ids[order], np.arange(ids.max() + 2, dtype=np.int32))
        return owner[order], starts.astype(np.int32)

    postings, starts = index(np.arange(len(ids), dtype=np.int32))
    indexed = count
    for seed in range(count):
        if not waiting[seed]:
            continue
        own = np.flatnonzero(component == component[seed])
        waiting[own] = False
        queue = [*own]
        while queue and waiting.any():
            at = queue.pop()
            alive = int(waiting.sum())
            if alive < indexed // 2:  # those reached already are looked at no more
                postings, starts = index(np.flatnonzero(waiting[owner]))
                indexed = alive
            mine = ids[bounds[at]:bounds[at + 1]]
            low, high = starts[mine], starts[mine + 1]
            span = high - low
            where = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum(dtype=np.int64))
            common = np.bincount(postings[where], minlength=count)
            linked = waiting & (100 * common >= percent * (sizes[at] + sizes - common))
            for j in np.flatnonzero(linked):
                if waiting[j]:
                    edges.append((at, int(j)))
                    more = np.flatnonzero((component == component[j]) & waiting)
                    waiting[more] = False
                    queue.extend(more)
    return edges


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links among rows of (family, block, other, signature, component, shingles), block by block."""
    dealt = rows.repartition("family", "block", "other").sortWithinPartitions("family", "block", "other", "signature")
    return dealt.mapInArrow(_confirm(percent), "a string, b string")


def confirmed_links(sets: DataFrame, family: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect exactly what full sets connect.  sets: signature, shingles."""
    sized = family.select(F.col("node").alias("signature"), F.col("root").alias("family")).join(sets, "signature")
    total = sized.groupBy("family").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.length("shingles") / 8).alias("shingle_sum"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingle_sum") / BLOCK_SHINGLES)).cast("int")
    rows = staged(sized.join(total.select("family", blocks.alias("blocks")), "family").withColumn(
        "block", F.pmod(F.xxhash64("signature"), F.col("blocks")).cast("int")), "rows", folder)

    # pivots of families of several blocks go to each block
    order = F.struct(F.xxhash64("signature", F.lit("pivot")).alias("h"), F.col("signature"))
    large = rows.where("blocks > 1")
    pivots = large.groupBy("family", F.pmod(F.xxhash64("signature", F.lit("slot")), F.lit(PIVOTS)).alias("slot")).agg(
        F.min_by("signature", order).alias("signature"))
    spread = (large.join(pivots.select("family", "signature"), ["family", "signature"])
              .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
              .withColumn("block", F.col("to")).drop("to"))
    first = rows.unionByName(spread).select(
        "family", "block", F.lit(-1).alias("other"), "signature", F.col("signature").alias("component"), "shingles")
    links = staged(_in_blocks(first, percent), "links", folder)
    if large.isEmpty():
        return links

    # what is outside the main component of a large family meets every other block
    roots = connected(links, "rooted")
    placed = large.join(roots.select(F.col("node").alias("signature"), "root"), "signature", "left").withColumn(
        "component", F.coalesce("root", "signature")).drop("root")
    main = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"))
    placed = staged(placed.join(main, "family"), "placed", folder)
    outside = placed.where("component <> main")
    meeting = outside.select("family", F.col("block").alias("other")).distinct()
    visitors = outside.withColumn("other", F.col("block")).withColumn(
        "to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block").withColumn("block", F.col("to"))
    hosts = placed.join(meeting, "family").where("other <> block")
    columns = ["family", "block", "other", "signature", "component", "shingles"]
    second = hosts.select(columns).unionByName(visitors.select(columns))
    return links.unionByName(staged(_in_blocks(second, percent), "late_links", folder))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              shingle: int = SHINGLE) -> DataFrame:
    """signature and shingles (64-bit, sorted) of one document of each wanted class (signature, doc_id)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in text_slices(batches, "text", SLICE_BYTES):
            sets = [shingle_set(t, hashes, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(s).hexdigest() for s in sets], pa.string()), pa.array(sets, pa.binary())],
                ["signature", "shingles"])

    ids = wanted.select("doc_id").distinct()
    texts = source.join(ids, source["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    return texts.mapInArrow(run, "signature string, shingles binary").dropDuplicates(["signature"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Sets of shingles of ``shingle`` words are linked if at least ``percent`` % of their union is common.
    """
    folder = run_folder(docs.sparkSession, "near")
    made = staged(sketches(docs, id_col, text_col, shingle), "sketches", folder)
    classes = staged(made.where(F.col("signature").isNotNull()).groupBy("signature").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"),
        F.min("registers").alias("registers")), "classes", folder)
    family = staged(families(classes, folder, percent), "family", folder)
    wanted = classes.join(family.select(F.col("node").alias("signature")), "signature").select("signature", "doc_id")
    sets = staged(full_sets(docs, wanted, id_col, text_col, shingle), "sets", folder)
    roots = staged(connected(confirmed_links(sets, family, folder, percent), "components"), "roots", folder)

    named = classes.select("signature", "doc_id").join(
        roots.select(F.col("node").alias("signature"), "root"), "signature", "left").withColumn(
        "root", F.coalesce("root", "signature"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("signature", "component_id")
    component = F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (made.select("doc_id", "n_shingles", "signature").join(of_class, "signature", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                           shingle=SHINGLE, percent=PERCENT)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS g
  FROM w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id
"""
