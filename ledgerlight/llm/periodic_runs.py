"""Maximal periodic runs of words by uniting suffix classes in descending order of their LCP.

A run is a stretch of words with smallest period q, at least twice as long as
q and at least ``min_length``, that can't be made longer on either side.

Suffixes of a text are sorted by doubling, which leaves the ranks of all
windows of 1, 2, 4, ... words; the longest common prefix (LCP) of neighbours
in that order follows from those ranks.  Then, as in Kruskal's algorithm,
neighbours are united from the largest LCP down, by union-find over ordered
sets of positions; the smaller set goes into the larger one.  Two positions i
and j that become adjacent in a set when their classes are united with LCP l
start with the same l words, and no position between them does.  If their
distance is at most l, the words from i to j + l have the smallest period
j - i.  They can't be extended to the right, and are a run if the words before
i and before j differ.  Every run is found so at its start: were a position k
between the starts i and i + q of its first two periods in their class, the
first period would be a repetition itself, and q not the smallest period.

Only LCPs of half of ``min_length`` or more can lead to a run, so texts in
which no window of so many words occurs twice are left out after one sort of
window hashes, and uniting ends there.

At scale: every text is judged alone, in one pass without a shuffle.  All
texts of a batch are sorted together.  A text is one row, and is held by one
task with arrays of about 4 bytes a word for each doubling.

Defined cases: a null or empty text has no words and no runs and collapses to
the empty text; repeated rows each get a row; null ids stay null; an empty
table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import let, staged, text_slices

MIN_LENGTH = 12
SLICE_BYTES = 1 << 20
#: Positions in a block of an ordered set, at most.
BLOCK = 2048


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves few of them."""

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [array("i", [first])], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Inserts x, which is not there yet; its neighbours."""
        blocks = self.blocks
        b = max(bisect_right(self.heads, x) - 1, 0)
        block = blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else blocks[b - 1][-1] if b else None
        after = block[at] if at < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else None
        block.insert(at, x)
        self.size += 1
        if not at:
            self.heads[b] = x
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks.insert(b + 1, block[half:])
            self.heads.insert(b + 1, block[half])
            del block[half:]
        return before, after


def words_of(texts):
    """(words as numbers, words of each text, the distinct words) of an Arrow column of strings without nulls."""
    import numpy as np
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)
    offsets = offsets[texts.offset:].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    cut = np.zeros(len(data) + 1, dtype=bool)  # between the bytes before and at a place
    cut[offsets] = True
    begins, ends = cut[:-1].copy(), cut[1:].copy()
    begins[1:] |= white[:-1]
    ends[:-1] |= white[1:]
    starts = np.flatnonzero(begins & ~white)
    stops = np.flatnonzero(ends & ~white) + 1
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~white])).dictionary_encode()
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return found.indices.to_numpy(zero_copy_only=False), counts, found.dictionary


def texts_with_repeats(words, counts, width: int):
    """Whether a window of ``width`` words occurs twice, for each text; rarely true by a clash of hashes."""
    import numpy as np

    out = np.zeros(len(counts), dtype=bool)
    n = len(words) - width + 1
    if n < 2:
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        window = window * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    window = window[text[:n] == text[width - 1:]]
    home = text[:n][text[:n] == text[width - 1:]]
    order = np.argsort(window)
    same = np.flatnonzero(window[order][1:] == window[order][:-1])
    out[home[order[same]]] = True
    return out


def suffix_order(words, counts):
    """Positions in order of (text, suffix), and the ranks of all windows of 1, 2, 4, ... words.

    Two positions have the same rank in a level if their windows are equal and
    in one text.  A window that ends behind its text is like no other.
    """
    import numpy as np

    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    keys = text * (int(words.max()) + 1) + words
    order = np.argsort(keys, kind="stable")
    heads = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    levels, step = [], 1
    while True:
        # the rank of a group is the place where it begins
        first = np.maximum.accumulate(np.where(heads, np.arange(n), 0)).astype(np.int32)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = first
        levels.append(rank)
        shared = np.flatnonzero(~heads | ~np.append(heads[1:], True))
        if not len(shared):
            return order, levels
        at = order[shared]
        inside = at + step < stop[at]
        second = np.where(inside, rank[np.minimum(at + step, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[at]))
        order[shared] = at = at[again]
        second = second[again]
        heads[shared[1:]] |= (second[1:] != second[:-1]) & (rank[at[1:]] == rank[at[:-1]])
        step *= 2


def neighbour_lcps(order, levels, counts, least: int):
    """(position, position, LCP) of neighbours in the order that share ``least`` words or more."""
    import numpy as np

    stop = np.repeat(np.cumsum(counts), counts)
    a, b = order[:-1], order[1:]
    low = (least.bit_length() - 1)
    if low >= len(levels):
        return a[:0], b[:0], a[:0]
    near = levels[low][a] == levels[low][b]
    a, b = a[near], b[near]
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < stop[a]) & (y < stop[b])
        equal = np.zeros(len(a), dtype=bool)
        equal[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        shared[equal] += 1 << k
    kept = shared >= least
    return a[kept], b[kept], shared[kept]


def seeds(a, b, lcps, n: int):
    """(i, j, LCP) of positions that become adjacent at a distance within the LCP, uniting by descending LCP."""
    import numpy as np

    parent, sets, found = array("i", range(n)), {}, array("q")

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = np.argsort(-lcps, kind="stable")
    for start in range(0, len(order), 1 << 16):
        part = order[start:start + (1 << 16)]
        for x, y, lcp in zip(a[part].tolist(), b[part].tolist(), lcps[part].tolist()):
            x, y = root(x), root(y)
            large, small = sets.pop(x, None) or Positions(x), sets.pop(y, None) or Positions(y)
            if large.size < small.size:
                x, y, large, small = y, x, small, large
            parent[y] = x
            sets[x] = large
            last = waiting = None  # of the smaller set: the one before, and what it might be adjacent to
            for p in small:
                if waiting is not None and waiting < p:
                    if waiting - last <= lcp:
                        found.extend((last, waiting, lcp))
                before, waiting = large.add(p)
                if before is not None and before != last and p - before <= lcp:
                    found.extend((before, p, lcp))
                last = p
            if waiting is not None and waiting - last <= lcp:
                found.extend((last, waiting, lcp))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 3).T


def find_runs(words, counts, min_length: int = MIN_LENGTH):
    """(text, start, length, period) of all runs of some texts, in this order."""
    import numpy as np

    least = -(-min_length // 2)
    found = np.zeros((4, 0), dtype=np.int64)
    some = np.flatnonzero(texts_with_repeats(words, counts, least))
    if not len(some):
        return found
    chosen = np.zeros(len(counts), dtype=bool)
    chosen[some] = True
    words, counts = words[np.repeat(chosen, counts)], counts[some]
    order, levels = suffix_order(words, counts)
    i, j, lcp = seeds(*neighbour_lcps(order, levels, counts, least), len(words))
    text = np.repeat(np.arange(len(counts)), counts)
    first = (np.cumsum(counts) - counts)[text]
    maximal = (i == first[i]) | (words[i - 1] != words[j - 1])
    i, j, lcp = i[maximal], j[maximal], lcp[maximal]
    start, length, period = i - first[i], j - i + lcp, j - i
    found = np.stack([some[text[i]], start, length, period])[:, length >= min_length]
    return found[:, np.lexsort((found[3], found[1], found[0]))]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row.

    ``runs`` has start, length and period in words, by start, then period.
    ``collapsed`` is the text without the words that follow the first period
    of any run, words joined by one space.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in text_slices(batches, "text", SLICE_BYTES):
            if not batch.num_rows:
                continue
            words, counts, distinct = words_of(batch.column("text"))
            text, start, length, period = find_runs(words, counts, min_length)
            firsts = np.cumsum(counts) - counts
            depth = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(depth, firsts[text] + start + period, 1)
            np.add.at(depth, firsts[text] + start + length, -1)
            kept = np.cumsum(depth)[:-1] == 0
            kept_before = np.concatenate([[0], np.cumsum(kept)])
            bounds = kept_before[np.append(firsts, len(words))].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(bounds), distinct.take(pa.array(words[kept]))), " ")
            cuts = np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(v) for v in (start, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), runs, collapsed],
                ["doc_id", "n_words", "runs", "collapsed"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, "
                                "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text, in which a tenth of the documents repeat a stretch of their words from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            words, place(i).cast("int"))), " ")).otherwise(text)
    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeated)
                  ).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest (ties: smallest start, then period), digests of runs and collapsed text."""
    order = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = found.withColumn("best", order)
    length, start, period = F.col("best")["length"], -F.col("best")["start"], -F.col("best")["period"]
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    # a stage, whose batches for Python are bounded in bytes; only digests are written
    return staged(run_digests(periodic_runs(planted)), "runs")
