import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import best_fit_packing as B

SF_SMALL = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")
SAMPLES = ["", " ", "a  b", " lead", "trail ", "a   b", "x\n y\n  z", "it's  'll \t q", "a  b 　c", "\n", "\nA",
           "x\nA\n\nB", "<|endoftext|> hi <|endoftext|>x|y  ", "  ", "é 中文 ét", "a \x1f b \x85 c", "   d", "q.\n", "don't.stop",
           "a_b-c d's 's", "1.5 2,5x", " x y", "ab\r\ncd", "x" * 5000, "naïve\nÜber", "\n\n", "|a|b", "w.\nThe\n"]


def library(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_like_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = list("ab.,' \n\t é中|<>7_") + ["  ", " x", "<|endoftext|>", "'s", "\n\n"]
    texts = SAMPLES + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(4000)]
    column = pa.array(["before", *texts], pa.string()).slice(1)  # a column that starts inside its buffers
    flat, n = B.encode_texts(column, PATH, B.END_ID)
    ends = np.cumsum(n)
    for text, start, end in zip(texts, ends - n, ends):
        assert flat[start:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], repr(text)


@pytest.mark.parametrize("kept", [4, 40, 1000])
def test_ids_with_few_kept_stretches(kept, monkeypatch):
    monkeypatch.setattr(B, "KEPT_STRETCHES", kept)
    B.stretch_ids.cache_clear()
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(kept)
    words = [f"{a}{b}" for a in "the of and x1 é! (no)".split() for b in ("", "s", "ing", ".\n", ",")]
    for _ in range(60):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(4)]
        flat, n = B.encode_texts(pa.array(texts), PATH, B.END_ID)
        assert flat.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    assert len(B.stretch_ids(PATH).known) <= kept + 40
    B.stretch_ids.cache_clear()
    assert B.encode_texts(pa.array(["", ""]), PATH, 2)[0].tolist() == [2, 2]


def plain_best_fit(lengths, capacity, limit):
    """The same choices by looking at every open bin."""
    bins, out, made = {}, [], 0  # free space by bin, in the order in which it got it
    for n in lengths:
        fitting = [(free, -when, b) for b, (free, when) in bins.items() if free >= n]
        if fitting:
            free, _, b = min(fitting)
            del bins[b]
        else:
            free, b, made = capacity, made, made + 1
        out.append((b, capacity - free))
        if free > n:
            if len(bins) == limit:
                del bins[min(bins, key=lambda x: (bins[x][0], -bins[x][1]))]
            bins[b] = (free - n, len(out))
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_open_bins_like_a_plain_search(limit):
    rng = random.Random(limit)
    lengths = [rng.randint(1, 40) for _ in range(3000)]
    bins = B.OpenBins(40, limit)
    got = [bins.place(n) for n in lengths]
    assert got == plain_best_fit(lengths, 40, limit)
    assert bins.n_open <= limit
    for bad in (0, 41):
        with pytest.raises(ValueError):
            bins.place(bad)


def check_packed(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_documents(spark):
    texts = [*SAMPLES, None, "word " * 5000, "Satz um Satz. " * 1200]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, " lead", "y", 2), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    pieces = B.pieces(docs, PATH)
    packed = B.pack(pieces).collect()
    check_packed(packed, 1024)
    wanted = []
    for i, text, *_ in rows:
        ids = library(text or "") + [2]
        first = len(ids) % 1024 or 1024
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            start = max(0, end - 1024) if k else 0
            wanted.append((i, k, start, end - start, np.array(ids[start:end], dtype="<u4").tobytes()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in packed), key=key) == sorted(wanted, key=key)
    whole = B.sequences(B.pack(pieces)).collect()
    assert sum(r.n_ids for r in whole) == sum(w[3] for w in wanted)
    assert all(len(r.ids) == 4 * r.n_ids for r in whole)
    assert sorted(b"".join(bytes(r.ids) for r in whole)) == sorted(b"".join(w[4] for w in wanted))


def test_several_tasks_and_few_sequences(spark):
    rng = random.Random(8)
    lengths = [min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000)]
    rows = spark.createDataFrame([(7, n, "same") for n in lengths], "id long, length long, other string")
    packed = B.pack(rows, pieces_per_task=6000)
    got = packed.collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    assert check_packed(got, 1024) <= 1.02 * sum(lengths) / 1024 + 4
    few = B.pack(rows, pieces_per_task=6000, open_bins=2).collect()
    assert sorted(r.length for r in few) == sorted(lengths)
    check_packed(few, 1024)


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert B.pack(B.pieces(docs, PATH)).count() == 0
    rows = spark.createDataFrame([(1, 5)], "offset long, length long")
    with pytest.raises(ValueError):
        B.pack(rows)
    for bad in (None, 0, 2000):
        with pytest.raises(Exception, match="has no place"):
            B.pack(spark.createDataFrame([(bad,)], "length long")).collect()


def test_query(spark):
    got = B.op11_best_fit_packing(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(docs)
    n = check_packed(got, 1024)
    assert n <= 1.02 * sum(r.length for r in got) / 1024 + 1
    tokenizer = Tokenizer.from_file(PATH)
    for r in got:
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [2]
        part = np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
