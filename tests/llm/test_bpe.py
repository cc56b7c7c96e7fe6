import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from ledgerlight.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "x", "a" * 5000, " " * 3000 + "b", "ab c\n\n  d " * 900, "don't we'll  \t\r\n 12345 ½ 中文字 \U0001f600!!" * 120,
         "\x00\x1c\x85\xa0 ", "é" * 700 + " " + "ñandú " * 400, "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5]), (None, "x y")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'z' as text_key")


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (300, 40), (64, 63)])
def test_like_the_library(spark, docs, chunk, overlap):
    encoder = bpe.load(PATH, P.PATTERN)[0]
    rows = bpe.token_digests(docs, PATH, chunk=chunk, overlap=overlap, keep_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = ("x y" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = np.array(encoder.encode_ordinary(text), dtype="<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def merged(piece, ranks):
    """Byte pairs merged by the lowest rank, the leftmost first, until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_like_a_naive_merge():
    import base64
    import random

    import regex
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = random.Random(6)
    letters = list("abcdeéñ ü\n'st12.,;中ß") + ["the ", " ing", "tion", "  "]
    for t in [*TEXTS[2:4], *TEXTS[5:], *("".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(400))]:
        t = t[:3000]
        want = [i for m in regex.finditer(P.PATTERN, t) for i in merged(m.group().encode(), ranks)]
        assert np.frombuffer(bpe.encode_text(t, PATH, P.PATTERN), "<u4").tolist() == want, t[:80]


def test_runs_that_the_library_cannot_match(spark):
    """A run of white space beyond the library's stack still encodes, and decodes to itself."""
    text = " " * 2_000_000 + "b"
    ids = bpe.encode_text(text, PATH, P.PATTERN)
    assert bpe.decode_ids(ids, PATH, P.PATTERN) == text.encode()


def test_overlap_must_fit(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, chunk=10, overlap=10)


def test_empty_table(docs):
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0
