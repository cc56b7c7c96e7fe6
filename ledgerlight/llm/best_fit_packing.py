"""Documents packed into sequences of a fixed length by bounded-space online best fit.

A document is its token ids and an end id.  One that is longer than a sequence
is cut into whole sequences, only its first piece may be shorter; so a piece
is never longer than a sequence.  A piece goes where the least space remains
that still holds it.  The open bins are kept in stacks by their free space,
and a bitset has one bit for each free space that any open bin has: the best
fit is the lowest bit from the piece's length on, the fullest open bin is the
lowest bit of all.  At most ``open_bins`` bins are open; if a new one would be
one too many, the fullest closes first.

Ids come from the tokenizers library.  Texts are cut into stretches at places
where a pre-token surely begins and where the text before it is read as it
would be at the end of a text: before a space that precedes a character other
than white space, behind a line end between two such characters, and before a
mark that ends a word of letters.  Each distinct stretch is encoded once and
kept for a while; ids of a text are gathered from those of its stretches.

At scale: encoding is row-local.  Whole sequences need no search and no
shuffle.  The other pieces are dealt evenly over tasks of about
``PIECES_PER_TASK``; they arrive in Arrow batches, and of a batch the longest
is placed first, which leaves small pieces for the gaps.  A task holds one
batch and the open bins.  All numbers derive from staged rows, so a task that
runs again gives the same sequences.

Defined cases: a null text is the empty text, which is its end id alone;
repeated rows are packed each; null ids stay null; an empty table gives an
empty result; other columns are not read by ``pieces`` and kept by ``pack``,
which refuses columns named like its own two, and lengths that are null, below
one or longer than a sequence.  The string of a special token in a text is
that token, as the library has it.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import staged, text_slices

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 8192
PIECES_PER_TASK = 131_072
SLICE_BYTES = 4 << 20
#: Distinct stretches whose ids a worker keeps; beyond that the rarest go.
KEPT_STRETCHES = 800_000

#: Kinds of bytes; from _DARK on a byte surely begins a character other than white space.
_SPACE, _LINE_END, _DARK, _LETTER, _MARK = range(1, 6)


class OpenBins:
    """At most ``limit`` open bins of ``capacity``, by free space; ``place(n)`` is (bin, offset) of a piece of n."""

    def __init__(self, capacity: int, limit: int) -> None:
        if limit < 1:
            raise ValueError("at least one bin must be open")
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_bits = 0
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        taken = stack.pop()
        if not stack:
            self.free_bits ^= 1 << free
        self.n_open -= 1
        return taken

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} has no place in a sequence of {self.capacity}")
        fitting = self.free_bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - n
        if left:  # a full bin needs no place among the open ones
            if self.n_open == self.limit:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            self.by_free[left].append(chosen)
            self.free_bits |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - free


@lru_cache(maxsize=1)
def byte_kinds():
    """The kind of each byte; 0 for white space, control bytes and the bytes that other white space may have."""
    import numpy as np

    kinds = np.zeros(256, dtype=np.uint8)
    kinds[0x21:0x7F] = _MARK
    kinds[[*b"0123456789'|"]] = _DARK  # a special token may hold a bar behind a letter
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    kinds[[b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)]] = _DARK
    kinds[0x20], kinds[0x0A] = _SPACE, _LINE_END
    return kinds


def stretch_bounds(data, offsets):
    """Where stretches begin in the UTF-8 bytes of some texts, and how many each text has."""
    import numpy as np

    kind = byte_kinds()[data]
    filled = offsets[1:] > offsets[:-1]
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    begins = np.zeros(len(data), dtype=bool)
    begins[2:] = (kind[:-2] >= _DARK) & (kind[1:-1] == _LINE_END) & (kind[2:] >= _DARK)
    begins[np.minimum(firsts + 1, len(data) - 1)] = False  # it looked into the text before
    begins[1:] |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
    space = (kind[:-1] == _SPACE) & (kind[1:] >= _DARK)
    space[lasts[lasts < len(space)]] = False  # it looked into the next text
    begins[:-1] |= space
    begins[firsts] = True
    at = np.flatnonzero(begins)
    return at, np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


class StretchIds:
    """Ids of stretches; each distinct one is encoded once while it is kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        #: All ids, where those of each stretch begin, how many it has, and in how many calls it was seen.
        self.flat, self.begins, self.sizes, self.seen = array("I"), array("q"), array("q"), array("q")

    def forget(self) -> None:
        """Keeps what was seen in two calls or more, at most half of what may be kept."""
        import numpy as np

        begins, sizes, seen = (np.array(a, dtype=np.int64) for a in (self.begins, self.sizes, self.seen))
        least = max(2, int(np.partition(seen, -KEPT_STRETCHES // 2)[-KEPT_STRETCHES // 2]) + 1
                    if len(seen) > KEPT_STRETCHES // 2 else 2)
        keep = np.flatnonzero(seen >= least)
        place = np.full(len(seen), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.known = {s: place[i] for s, i in self.known.items() if place[i] >= 0}
        sizes, ends = sizes[keep], np.cumsum(sizes[keep])
        at = np.repeat(begins[keep] - (ends - sizes), sizes) + np.arange(sizes.sum())
        self.flat = array("I", np.array(self.flat, dtype=np.uint32)[at].tobytes())
        self.begins, self.sizes, self.seen = (array("q", a.tobytes()) for a in (ends - sizes, sizes, seen[keep] // 2))

    def of(self, stretches: list[bytes]):
        """All kept ids, and for each of the distinct stretches where its ids begin and how many it has."""
        import numpy as np

        if len(self.known) + len(stretches) > KEPT_STRETCHES:
            self.forget()
        new = [s for s in stretches if s not in self.known]
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in part],
                                                                     add_special_tokens=False)]
            sizes = list(map(len, found))
            self.known.update(zip(part, range(len(self.sizes), len(self.sizes) + len(part))))
            self.begins.extend(accumulate(sizes[:-1], initial=len(self.flat)))
            self.sizes.extend(sizes)
            self.seen.extend([0] * len(part))
            self.flat.extend(chain.from_iterable(found))
        at = np.fromiter(map(self.known.__getitem__, stretches), dtype=np.int64, count=len(stretches))
        np.frombuffer(self.seen, dtype=np.int64)[at] += 1
        return (np.array(self.flat, dtype="<u4"), np.array(self.begins, dtype=np.int64)[at],
                np.array(self.sizes, dtype=np.int64)[at])


@lru_cache(maxsize=2)
def stretch_ids(path: str) -> StretchIds:
    return StretchIds(path)


def encode_texts(texts, path: str, end_id: int):
    """Ids of all texts of an Arrow column without nulls, one after the other, and the number of each with its end id."""
    import numpy as np
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)
    offsets = offsets[texts.offset:].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    at, per_text = stretch_bounds(data, offsets)
    bounds = np.append(at, len(data)).astype(np.int64)
    stretches = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    kept, begins, sizes = stretch_ids(path).of(stretches.dictionary.to_pylist())
    begins, sizes = np.append(begins, len(kept)), np.append(sizes, 1)  # the end id stands behind the kept ones
    which = np.insert(stretches.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                      np.cumsum(per_text), len(sizes) - 1)
    counts = sizes[which]
    ends = np.cumsum(counts)
    flat = np.append(kept, np.uint32(end_id))[np.repeat(begins[which] - (ends - counts), counts) + np.arange(counts.sum())]
    return flat, np.diff(ends[np.cumsum(per_text + 1) - 1], prepend=0)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit integers) of every piece of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in text_slices(batches, "text", SLICE_BYTES):
            if not batch.num_rows:
                continue
            flat, n_ids = encode_texts(batch.column("text"), path, end_id)
            n_pieces = -(-n_ids // capacity)
            row = np.repeat(np.arange(len(n_ids)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = (n_ids - (n_pieces - 1) * capacity)[row]
            length = np.where(piece == 0, first, capacity)
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), ids], ["doc_id", "piece", "start", "length", "ids"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, "
                                "length long, ids binary")


def pack(rows: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """All columns of ``rows`` and the sequence (sequence_id) and place in it (offset) of each row's ``length_col``."""
    if clash := {"sequence_id", "offset"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"rename {sorted(clash)} before packing")
    rows = staged(rows, "pieces")
    whole = rows.where(F.col(length_col) == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = whole.columns
    short = rows.where(~F.col(length_col).eqNullSafe(F.lit(capacity)))
    tasks = max(1, -(-short.count() // pieces_per_task))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40  # sequences of different tasks have different numbers
        for batch in batches:
            if batch.column(length_col).null_count:
                raise ValueError("a piece without length has no place")
            lengths = batch.column(length_col).to_numpy(zero_copy_only=False)
            order = np.argsort(-lengths, kind="stable")
            placed = np.zeros((len(lengths), 2), dtype=np.int64)
            for i, n in zip(order.tolist(), lengths[order].tolist()):
                placed[i] = bins.place(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], names)
    return whole.unionByName(short.repartition(tasks).mapInArrow(run, whole.schema))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and ids of every sequence; a sequence has at most as many pieces as ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
            .select("sequence_id", "n_ids",
                    F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
