import hashlib
import random
import re

import pytest

from ledgerlight.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 12) if v else 0):
            win = v[i:i + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    if item is not None:
                        found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(6)] + ["Ünï", "É", "a1"]
    item = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 3, 13, 14, 20, 40]))) for i in range(25)]
    items = [x for x in items if len(words(x[1])) > 2 or x[0] % 4 == 0]
    items += [(100, None), (101, "..."), (7, items[0][1]), (items[1][0], items[1][1])]
    docs = [None, "", "!!!", items[0][1], "x " * 30000 + items[0][1] + " y" * 30000]
    for _ in range(60):
        parts = [item(rng.randint(0, 30)) if rng.random() < 0.6 else rng.choice(items)[1] or "" for _ in range(4)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(parts).replace(" w1", rng.choice([" w1", " W1,", "-w1"])))
    return docs, items


@pytest.mark.parametrize("shard, block", [(D.SHARD_BYTES, D.BLOCK_WORDS), (500, 40)])
def test_like_brute_force(spark, data, monkeypatch, shard, block):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = data
    rows = list(enumerate(docs)) + [(3, docs[3]), (None, docs[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'s' as shard")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.hit_digests(D.decontaminate(df, bench)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(docs[3] if r.doc_id is None else docs[r.doc_id], items), r.doc_id


@pytest.mark.parametrize("block", [1, 1000])
def test_no_row_is_lost_among_equal_shards(spark, monkeypatch, block):
    """Eight rows of one text in eight shards with equal postings, searched with several blocks of queries."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rows = [(7, "one two three four")] * 4 + [(None, "one two three four")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(1, "two three"), (2, "nine ten"), (3, "four")], "item_id long, text string")
    got = D.hit_digests(D.decontaminate(df, bench)).collect()
    assert len(got) == 8 and {(r.n_hit, r.n_items, r.contaminated) for r in got} == {(3, 2, True)}


def test_one_index_serves_any_benchmark(spark, data, monkeypatch):
    docs, items = data
    monkeypatch.setattr(D, "MAX_TERMS", 2)  # so the index keeps all terms
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    index = D.build_index(df)
    for part in (items[:8], items[8:]):
        bench = spark.createDataFrame(part, "item_id long, text string")
        found = D.search_phrases(index, D.query_blocks(bench)).select("doc_id", "n_words", "items", "spans")
        for r in D.hit_digests(found).collect():
            assert tuple(r)[1:] == brute(docs[r.doc_id], part), r.doc_id
        again = D.hit_digests(D.decontaminate(df, bench)).collect()
        assert sorted(again) == sorted(D.hit_digests(found).collect())


def test_items_without_id_have_no_windows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    assert D.hit_digests(D.decontaminate(df, bench)).first().n_hit == 0
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert not D.hit_digests(D.decontaminate(df, bench.limit(0))).first().contaminated


def test_index_holds_all_positions(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, "A")], "doc_id long, text string").coalesce(1)
    index = D.build_index(df)
    shard = D.Shard(index.first().asDict())
    assert shard.positions(b"b").tolist() == [0, 2]
    assert shard.positions(b"a").tolist() == [1, int(shard.starts[2])]
    assert {bytes(r.term): r.n for r in D.term_counts(index).collect()} == {b"a": 2, b"b": 2}


def test_proximity_like_brute_force(spark):
    rng = random.Random(8)
    docs = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {}
    for r in D.search_near(D.build_index(df), ["a", "b", "c"], 5).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end))
    for i, d in enumerate(docs):
        w = d.split()
        spans = {(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 5) + 1)
                 if {"a", "b", "c"} <= set(w[a:b])}
        least = {(a, b) for a, b in spans if not any((c, e) != (a, b) and a <= c and e <= b for c, e in spans)}
        assert got.get(i, set()) == least, d
    with pytest.raises(ValueError):
        D.search_near(D.build_index(df), ["a"], D.GAP + 1)
