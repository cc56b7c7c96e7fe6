import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlight.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_SMALL = "/root/testdata/sf0.001"


def brute(w, least=12):
    """All runs by trying every period from every start."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                s = w[i:i + length]
                if not any(s[r:] == s[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repetitive(rng):
    n, letters = rng.randint(0, 60), rng.randint(1, 4)
    w = [rng.randint(0, letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        period, start = rng.randint(1, 8), rng.randint(0, n - 1)
        for i in range(start + period, rng.randint(start, n)):
            w[i] = w[i - period]
    return w


@pytest.mark.parametrize("block", [2, 2048])
def test_all_runs_like_brute_force(block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        least = rng.choice([2, 3, 5, 12, 13])
        got = R.find_runs(np.array(sum(texts, []), dtype=np.int32), np.array(list(map(len, texts))), least)
        assert list(map(tuple, got.T.tolist())) == [(i, *r) for i, w in enumerate(texts) for r in brute(w, least)]


@pytest.mark.parametrize("period", [1, 7, 30_000])
def test_one_long_run(period):
    words = np.resize(np.random.default_rng(period).permutation(period), 200_000).astype(np.int32)
    assert R.find_runs(words, np.array([len(words)])).T.tolist() == [[0, 0, 200_000, period]]


def test_documents(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "x y z " * 6, "a b c d e f g a b c d e f",
             " " * 3 + " é" * 30, "la la " * 40_000, "p q r " * 20 + "s " + "p q r " * 20]
    texts += [" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(200)]
    rows = [(i, t, 5, "z") for i, t in enumerate(texts)] + [(4, texts[4], 6, "y"), (None, texts[5], 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, n_words string").repartition(4)
    got = R.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall((texts[5] if r.doc_id is None else texts[r.doc_id]) or "")
        runs = brute(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), runs, collapsed(w, runs))
    assert R.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(docs, min_length=1)


def contract(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w, runs)))


def check_query(rows, got):
    want = sorted(((i, *contract(i, t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


def test_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "a " * 30), (None, None), (7, "b " * 30)]
    rows += [(i, None if i % 2 else "") for i in range(400, 440)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = check_query(rows, R.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert sum(w[1] > 1 for w in want) > 10


def test_query_on_the_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
            if len(r.text or "") < 8000]
    kept = {i for i, _ in docs}
    got = [r for r in R.op13_periodic_runs(spark, SF_SMALL).collect() if r.doc_id in kept]
    want = check_query(docs, got)
    assert sum(w[1] > 0 for w in want) >= 10
