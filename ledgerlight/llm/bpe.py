"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks of ``chunk`` characters that overlap by
``overlap``.  Chunks are pre-tokenised independently, in as many tasks as
there are chunks; in the overlap of two neighbours the pre-token boundaries
of both soon coincide, and from a common boundary on they stay the same,
because the pattern looks only forward.  The seam is put at the first common
boundary that follows a character other than white space (so that cutting
there leaves every look-ahead as it was), and each chunk then encodes the
pieces between its two seams.  A text with a seam that never resynchronises
(one run longer than the overlap) is pre-tokenised as one chunk.  Decoding
concatenates the raw bytes of the ids.

Texts of one chunk, nearly all, need no seam and no shuffle.  Chunks of long
texts are shuffled by (text, chunk), so a very long text is spread over tasks
and copies of one text are encoded once; the seams are found by a window over
the chunks of one text.

Defined cases: a null text is the empty text: no ids, empty bytes; repeated
rows each get a result; null ids stay null; an empty table gives an empty
result; only the two named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import text_slices

CHUNK = 1 << 15
OVERLAP = 1 << 10
SLICE_BYTES = 4 << 20

#: Unicode's White_Space, as the regular expressions of the tokeniser library have it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The library's encoder, the compiled pattern and the bytes of each id; once in a worker."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = (pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoder, regex.compile(own), {v: k for k, v in ranks.items()}


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    encoder, compiled, _ = load(path, pattern)
    if len(text) <= 4 * CHUNK:
        return encoder.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    # the library's own matcher runs out of stack on huge runs: match here, merge there
    single = encoder._core_bpe.encode_single_piece
    return b"".join(np.array(single(m.group().encode()), dtype="<u4").tobytes() for m in compiled.finditer(text))


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    import numpy as np

    table = load(path, pattern)[2]
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _per_row(column: str, out: str, fn: Callable, kind: str) -> Callable[[Iterator], Iterator]:
    """Replaces ``column`` of each batch by ``out``, in slices of bounded bytes."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_slices(batches, column, SLICE_BYTES):
            i = batch.schema.get_field_index(column)
            values = pa.array([fn(v) for v in batch.column(i).to_pylist()], pa.type_for_alias(kind))
            rest = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], values], [*rest, out])
    return run


def _boundaries(path: str, pattern: str, overlap: int) -> Callable[[Iterator], Iterator]:
    """Adds head and tail: boundaries after a character other than white space in the two overlaps."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compiled = load(path, pattern)[1]
        for batch in text_slices(batches, "text", SLICE_BYTES):
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                # the last piece may go on behind the chunk, so its end is no boundary
                ends = [e for e in (m.end() for m in compiled.finditer(text))
                        if e < len(text) and not text[e - 1].isspace()]
                heads.append([e for e in ends if e <= overlap])
                tails.append([e for e in ends if e > len(text) - overlap])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                [*batch.schema.names, "head", "tail"])
    return run


def _stitched(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(text_key, chunk_no, piece): the stretch of each chunk between its seams."""
    marked = chunks.mapInArrow(_boundaries(path, pattern, overlap),
                               "text_key string, chunk_no int, text string, head array<int>, tail array<int>")
    of_text = Window.partitionBy("text_key")
    nxt = F.lead("head").over(of_text.orderBy("chunk_no"))
    # positions of both lists from the start of this chunk
    common = F.array_min(F.array_intersect("tail", F.transform(nxt, lambda e: e + chunk)))
    last = F.col("chunk_no") == F.max("chunk_no").over(of_text)
    seamed = marked.select("text_key", "chunk_no", "text", last.alias("last"), common.alias("seam"))
    seamed = seamed.withColumn("broken", F.max((~F.col("last") & F.col("seam").isNull()).cast("int")).over(of_text))
    start = F.coalesce(F.lag("seam").over(of_text.orderBy("chunk_no")) - chunk, F.lit(0))
    piece = F.when(F.col("last"), F.substr("text", start + 1)).otherwise(
        F.substr("text", start + 1, F.col("seam") - start))
    # a text with a seam that never resynchronises is one chunk
    own = F.struct("chunk_no", F.substr("text", F.lit(1), F.lit(chunk)).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("broken") == 1, own)).over(of_text)),
                                     lambda s: s["text"]), "")
    return seamed.select("text_key", "chunk_no", F.when(F.col("broken") == 0, piece).when(
        F.col("chunk_no") == 0, whole).otherwise(F.lit("")).alias("piece"))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary) of every row."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    docs = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key_type = dict(docs.dtypes)["doc_id"]
    fn = lambda t: encode_text(t, path, pattern)
    length = F.length("text")
    short = docs.where(length <= chunk).mapInArrow(
        _per_row("text", "ids", fn, "binary"), f"doc_id {key_type}, ids binary")

    long = docs.where(length > chunk).withColumn("text_key", F.sha2("text", 256))
    starts = F.sequence(F.lit(0), F.floor((length - 1) / chunk).cast("int"))
    chunks = (long.select("text_key", "text", F.explode(starts).alias("chunk_no"))
              .select("text_key", "chunk_no", F.substr("text", F.col("chunk_no") * chunk + 1,
                                                       F.lit(chunk + overlap)).alias("text"))
              .dropDuplicates(["text_key", "chunk_no"]))
    pieces = _stitched(chunks, path, pattern, chunk, overlap).repartition("text_key", "chunk_no")
    encoded = pieces.mapInArrow(_per_row("piece", "ids", fn, "binary"), "text_key string, chunk_no int, ids binary")
    whole = (encoded.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))).alias("parts"))
             .select("text_key", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
    return short.unionByName(long.select("doc_id", "text_key").join(whole, "text_key").select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids and decoded (the raw bytes) of every row of doc_id and ids."""
    schema = encoded.schema.simpleString()[len("struct<"):-1].replace(":", " ", len(encoded.columns))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_slices(batches, "ids", SLICE_BYTES):
            out = pa.array([None if v is None else decode_ids(v, path, pattern)
                            for v in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def token_digests(docs: DataFrame, path: str, keep_ids: bool = False, **options) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes; with the ids if asked for."""
    ids = F.col("ids")
    return decode(encode(docs, path, **options), path).select(
        "doc_id", (F.length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        *[ids] * keep_ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
