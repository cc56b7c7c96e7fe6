import random
import re

import numpy as np
import pytest

from ledgerlight.llm import near_dedup as N
from ledgerlight.llm.common import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=3, percent=85):
    """Component (smallest doc_id) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    out = [None, "", " \n", "One", "one", "one two", "ONE\ttwo", "one two three", "a b c a b c a b c"]
    base = text(150)
    out += [near(rng, base, rng.randint(0, 7)) for _ in range(120)]  # links, chains and outsiders
    chain = text(200)
    for _ in range(12):  # each near the one before only
        chain = near(rng, chain, 4)
        out.append(chain)
    out += [text(rng.choice([3, 20, 100, 400])) for _ in range(60)]
    out += [text(100) + " " + base[:300] for _ in range(20)]
    out += [out[20]] * 15 + [out[30].upper(), text(20000)]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [rows[3], (None, "only here"), (None, out[20])]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as signature", "2 as kept", "'x' as root")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    want = sorted(((d, n, c, d is not None and d == c) for d, n, c in brute(rows)), key=str)
    assert got == want


def test_like_brute_force(spark, rows):
    check(spark, rows)


def test_like_brute_force_in_small_blocks(spark, rows, monkeypatch):
    """Buckets and families beyond one block lose no link either."""
    monkeypatch.setattr(N, "BLOCK", 12)
    monkeypatch.setattr(N, "PIVOTS", 3)
    check(spark, rows)


def test_five_words_and_eighty_percent(spark):
    """The pipeline's stage: copies between 80 % and 85 % are linked, those just below 80 % are not."""
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows, wanted = [], {}
    for k in range(150):  # a copy with a block appended: shared / union = 196 / (196 + block)
        base, block = text(200), rng.randint(30, 65)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + text(block)))]
        wanted[2 * k + 1] = 100 * 196 >= 80 * (196 + block)
    assert 40 < sum(wanted.values()) < 140
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in N.near_duplicates(df, shingle=5, percent=80).collect()}
    assert {i: not got[i].kept for i in wanted} == wanted
    assert [got[d].component_id for d, _ in rows] == [c for _, _, c in brute(rows, 5, 80)]


def test_bands_find_pairs_at_the_least_similarity():
    """Recall of the bands on 5,000 pairs of sets of exactly 80 %: 1.4e-5 a pair is missed, so none is expected."""
    rng, seeds = np.random.default_rng(5), N.register_seeds()
    missed = doubted = 0
    for k in range(5000):
        common, own = rng.integers(0, 2 ** 63, 80, dtype=np.uint64), rng.integers(0, 2 ** 63, 20, dtype=np.uint64)
        a, b = (N.registers(np.concatenate([common, part]), seeds) for part in (own[:10], own[10:]))
        missed += not (a == b).reshape(N.BANDS, N.BAND_ROWS).all(1).any()
        doubted += k < 500 and not N.maybe_linked(90, a, np.array([90]), b[None, :], 80)[0]
    assert missed <= 1 and doubted == 0


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(5, None)], "doc_id long, text string")
    assert tuple(N.near_duplicates(one).first()) == (5, 0, 5, True)


def test_registers_merge_and_estimate():
    rng, seeds = np.random.default_rng(1), N.register_seeds(4096)
    a = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    for shared in (0, 1500, 2800):
        b = np.concatenate([a[:shared], rng.integers(0, 2 ** 63, 2000, dtype=np.uint64)])
        ra, rb = N.registers(a, seeds), N.registers(b, seeds)
        assert (N.merge_registers(ra, rb) == N.registers(np.union1d(a, b), seeds)).all()
        j = shared / len(np.union1d(a, b))
        got, _ = N.estimate(3000.0, np.array([float(len(b))]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]),
                            np.array([(ra == rb).sum()]))
        assert abs(got[0] - j) < 0.05
        # equal registers are as frequent as the model says
        u, v = 3000 / (3000 + len(b)), len(b) / (3000 + len(b))
        assert abs((ra > rb).mean() - N._chance(u - v * j)) < 0.03


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {n: p for n, p in parent.items() if n != p or any(n in e and e[0] != e[1] for e in edges)}
