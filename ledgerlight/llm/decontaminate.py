"""Benchmark decontamination on a distributed positional inverted index.

The index is a stored table.  Each row is a shard: some consecutive
documents, their lengths in words, and for each term the ascending positions
at which it stands in the shard (documents lie behind one another, with a gap
that no match can cross).  Shards are built and searched where they are, so
neither step shuffles postings, and a shard holds a bounded number of bytes
however frequent a term is.

A search first sums the number of postings of each term over all shards.  A
phrase is looked up from its rarest term: that list, moved back by the term's
offset, is intersected with the moved lists of the other terms from rare to
frequent, until it is empty or only exact occurrences are left.  Proximity
asks for all given terms within so many consecutive words, in any order.

The phrases are those of a stated query set (the benchmark).  It is a stored
table of blocks of bounded size, each with the counts of its terms, and every
shard meets every block; so neither the query set nor the counts of the
corpus pass through the driver.  In a shard only phrases whose rarest term it
has are looked up.  An index serves any query set; ``decontaminate`` keeps only
the terms of its benchmark, unless they are more than ``MAX_TERMS``.

Defined cases: a null or empty text has no words and no hits; repeated rows
are judged one by one; null ids stay null; items without words or without id
have no windows, and rows that repeat an item count as one; empty tables give
empty results or no hits; only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import staged

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Between two documents of a shard; proximity may span up to this.
GAP = 1 << 10
#: Words of a block of the query set.
BLOCK_WORDS = 200_000
#: Distinct query terms up to which the index keeps only those terms.
MAX_TERMS = 1_000_000

SHARD_SCHEMA = ("shard string, doc_ids array<long>, n_words array<int>, terms array<binary>, counts array<int>, postings binary")

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of digits, a-z and characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


class Shard:
    """Postings of some documents in memory."""

    def __init__(self, row: dict) -> None:
        import numpy as np

        self.doc_ids = row["doc_ids"]
        self.n_words = np.asarray(row["n_words"], dtype=np.int64)
        self.starts = np.cumsum(self.n_words + GAP) - self.n_words - GAP
        ends = np.cumsum(row["counts"], dtype=np.int64)
        steps = np.frombuffer(zlib.decompress(row["postings"]), dtype="<i4")
        self.lists = {t: (e - c, e) for t, c, e in zip(row["terms"], row["counts"], ends)}
        self.steps = steps

    def positions(self, term: bytes):
        import numpy as np

        found = self.lists.get(term)
        if found is None:
            return None
        if isinstance(found, tuple):
            found = self.lists[term] = np.cumsum(self.steps[found[0]:found[1]], dtype=np.int64)
        return found

    def phrase(self, terms: list[bytes], order: list[int]):
        """Start positions of the exact phrase; ``order``: offsets from the rarest term on."""
        import numpy as np

        left = None
        for o in order:
            at = self.positions(terms[o])
            if at is None:
                return None
            if left is None:
                left = at - o
            else:
                i = np.searchsorted(at, left + o)
                i[i == len(at)] = len(at) - 1
                left = left[at[i] == left + o]
            if not len(left):
                return None
        return left

    def near(self, terms: list[bytes], within: int) -> list[tuple[int, int]]:
        """Smallest stretches of at most ``within`` words with all the distinct terms: (start, end)."""
        import heapq

        lists = [self.positions(t) for t in set(terms)]
        if not lists or any(x is None for x in lists):
            return []
        heads = [(int(x[0]), i, 0) for i, x in enumerate(lists)]
        heapq.heapify(heads)
        last, out = max(h[0] for h in heads), []
        while True:
            first, i, k = heads[0]
            if last - first < within and (not out or out[-1][1] != last + 1):
                out.append((first, last + 1))
            elif last - first < within:
                out[-1] = (first, last + 1)
            if k + 1 == len(lists[i]):
                return out
            following = int(lists[i][k + 1])
            last = max(last, following)
            heapq.heapreplace(heads, (following, i, k + 1))


def _build(vocabulary: frozenset[bytes] | None) -> Callable[[Iterator], Iterator]:
    def shard(ids: list, texts: list) -> dict:
        import numpy as np

        terms: dict[bytes, int] = {} if vocabulary is None else {t: i for i, t in enumerate(sorted(vocabulary))}
        coded, lens = [], []
        for text in texts:
            w = words_of(text)
            lens.append(len(w))
            if vocabulary is None:
                coded.append(np.fromiter((terms.setdefault(x, len(terms)) for x in w), np.int32, len(w)))
            else:
                get = terms.get
                coded.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)))
        n = np.asarray(lens, dtype=np.int64)
        starts = np.cumsum(n + GAP) - n - GAP
        codes = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(len(codes))
        kept = codes >= 0
        codes, at = codes[kept], at[kept]
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        steps = np.diff(at, prepend=0)
        steps[first] = at[first]
        names = sorted(terms, key=terms.get)
        return {"shard": uuid.uuid4().hex, "doc_ids": ids, "n_words": lens, "terms": [names[c] for c in codes[first]],
                "counts": np.diff(np.r_[first, len(codes)]).tolist(),
                "postings": zlib.compress(steps.astype("<i4").tobytes(), 1)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
                            ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())),
                            ("postings", pa.binary())])
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 64
                if size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist([shard(ids, texts)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([shard(ids, texts)], schema)
    return run


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write the index to the shared folder.  ``vocabulary``: keep the postings of these terms only."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(source.mapInArrow(_build(vocabulary), SHARD_SCHEMA), "index")


def term_counts(index: DataFrame) -> DataFrame:
    """term and n, its postings in the whole index."""
    return (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n")))


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; the whole item if it has fewer; none without words."""
    if not words:
        return []
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def query_blocks(benchmark: DataFrame) -> DataFrame:
    """block and items (name and words), of the items with a name; one empty block if there are none."""
    spark = benchmark.sparkSession
    source = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.list_(pa.binary()))],
                                             ["item", "words"])
    items = staged(source.mapInArrow(run, "item string, words array<binary>"), "items")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).agg(
        F.collect_list(F.struct("item", "words")).alias("items"))
    return staged(found, "blocks") if total else spark.createDataFrame([(0, [])], found.schema)


def with_counts(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """The blocks with the counts of their terms in the index."""
    terms = blocks.select("block", F.explode(F.array_distinct(F.flatten(F.transform(
        "items", lambda i: i["words"])))).alias("term"))
    asked = terms.select("term").distinct()
    counts = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
              .select(F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
              .join(asked, "term", "left_semi").groupBy("term").agg(F.sum("c").alias("n")))
    known = terms.join(counts, "term").groupBy("block").agg(F.collect_list(F.struct("term", "n")).alias("counts"))
    return staged(blocks.join(known, "block", "left"), "counted")


def phrases_by_rarest(items: list[dict], counts: list[dict], width: int) -> dict:
    """(name, terms, offsets from the rarest term on) of every window whose terms all occur, by its rarest term."""
    n = {bytes(c["term"]): c["n"] for c in counts}
    out: dict[bytes, dict] = {}
    for item in items:
        for terms in windows_of([bytes(w) for w in item["words"]], width):
            if all(t in n for t in terms):
                order = sorted(range(len(terms)), key=lambda o: n[terms[o]])
                # the same window of an item once
                out.setdefault(terms[order[0]], {})[item["item"], terms] = order
    return {t: [(name, list(terms), order) for (name, terms), order in found.items()] for t, found in out.items()}


def _search(width: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()),
                            ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        block, wanted = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != block:
                    block, wanted = row["block"], phrases_by_rarest(row["items"], row["block_counts"] or [], width)
                s = Shard(row)
                hits: dict[int, tuple[set, list]] = {}
                for item, terms, order in (p for t in wanted.keys() & s.lists.keys() for p in wanted[t]):
                    at = s.phrase(terms, order)
                    if at is not None:
                        for d, p in zip((np.searchsorted(s.starts, at, side="right") - 1).tolist(), at.tolist()):
                            p -= int(s.starts[d])
                            found = hits.setdefault(d, (set(), []))
                            found[0].add(item)
                            found[1].append((p, p + len(terms)))
                out = []
                for d, doc_id in enumerate(s.doc_ids):
                    found, spans = hits.get(d, ((), ()))
                    merged: list[list[int]] = []
                    for a, b in sorted(spans):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    out.append({"shard": row["shard"], "place": d, "doc_id": doc_id, "n_words": int(s.n_words[d]),
                                "items": sorted(found), "spans": [{"start": a, "end": b} for a, b in merged]})
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


HIT_SCHEMA = ("shard string, place int, doc_id long, n_words long, items array<string>, "
              "spans array<struct<start: int, end: int>>")


def search_phrases(index: DataFrame, blocks: DataFrame, width: int = WINDOW) -> DataFrame:
    """Every document of the index with the names of the items whose windows occur, and the merged spans of words.

    ``blocks`` as ``query_blocks`` makes them.
    """
    counted = with_counts(blocks, index).withColumnRenamed("counts", "block_counts")
    found = index.crossJoin(counted).mapInArrow(_search(width), HIT_SCHEMA)
    if counted.count() == 1:
        return found
    return (found.groupBy("shard", "place", "doc_id", "n_words")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                 merge_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans")))


def search_near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, start, end (in words) of the smallest stretches of at most ``within`` words with all terms."""
    if within > GAP:
        raise ValueError(f"proximity may span at most {GAP} words")
    wanted = [w for t in terms for w in words_of(t)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                out = []
                for a, b in s.near(wanted, within):
                    d = int(np.searchsorted(s.starts, a, side="right")) - 1
                    out.append({"doc_id": s.doc_ids[d], "start": a - int(s.starts[d]), "end": b - int(s.starts[d])})
                yield pa.RecordBatch.from_pylist(
                    out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    return index.mapInArrow(run, "doc_id long, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, items (whose windows occur), spans (hit words) of every document."""
    blocks = query_blocks(benchmark)
    terms = blocks.select(F.explode(F.flatten(F.transform("items", lambda i: i["words"]))).alias("term")).distinct()
    found = [bytes(r[0]) for r in terms.limit(MAX_TERMS + 1).toLocalIterator()]  # bounded
    vocabulary = frozenset(found) if len(found) <= MAX_TERMS else None
    index = build_index(docs, vocabulary, id_col, text_col)
    return search_phrases(index, blocks, width).select("doc_id", "n_words", "items", "spans")


def merge_spans(spans):
    """Sorted spans with overlapping and touching ones joined."""
    span = "array<struct<start:int,end:int>>"
    return F.aggregate(spans, F.array().cast(span), lambda a, s: F.when(
        F.size(a) == 0, F.array(s)).when(
        F.try_element_at(a, F.lit(-1))["end"] < s["start"], F.array_append(a, s)).otherwise(
        F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(
            F.try_element_at(a, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end")))))


def hit_digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hit_digests(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP9_SQL = r"""
WITH item AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
width AS (SELECT DISTINCT width FROM win),
hit AS (
  SELECT r, i, win.width, item_id
  FROM doc, width, unnest(range(1, greatest(0, len(w) - width + 1) + 1)) AS t(i), win
  WHERE win.width = width.width AND win.words = array_to_string(w[i:i + width.width - 1], ' ')),
place AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + width)) AS t(p) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN place USING (r) LEFT JOIN items USING (r)
"""
