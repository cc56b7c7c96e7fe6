import random
import unicodedata

import public_tokenizers as P
import pytest
import regex

from ledgerlight.llm import token_counts as T

PATH = P.path("word_bpe_49k.json")


def greedy(symbols, vocabulary):
    """Pieces of a word by trying ever shorter pieces; the mark alone costs nothing."""
    i = n = 0
    while i < len(symbols):
        j = next(j for j in range(len(symbols), i, -1)
                 if symbols[i:j] in vocabulary or j == i + 1)
        n += symbols[i:j] != (T.END,)
        i = j
    return n


@pytest.fixture(scope="module")
def vocabulary():
    return T.read_vocabulary(PATH)


def test_automaton_like_greedy_search(vocabulary):
    automaton, known = T.Automaton(vocabulary), set(vocabulary)
    rng = random.Random(4)
    letters = "abcdefghijklmnoprstuvwyzéñ中1!"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words += ["internationalisation", "the", "a" * 300, "straßenbahn", "\U0001f600\U0001f600"]
    for w in words:
        b = w.encode()
        assert automaton.pieces(b) == greedy((*b, T.END), known), w


def test_small_automaton_with_failures():
    v = [tuple(p.encode()) for p in ("abc", "abcde", "cd", "bcdf", "de")]
    automaton = T.Automaton(v)
    rng = random.Random(5)
    for _ in range(500):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12))).encode()
        assert automaton.pieces(w) == greedy((*w, T.END), set(v)), w


def test_counts_of_documents(spark, vocabulary):
    texts = [None, "", "  \n", "Hello, WORLD! it's 42", "é e\u0301", "x" * 70000, "word " * 30000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_words", "0 as n_pieces")
    got = T.count_tokens(df, PATH).collect()
    assert len(got) == len(rows)
    known, pattern = set(vocabulary), regex.compile(T.PATTERN)
    for r in got:
        if r.doc_id == 5:
            assert r.n_words == 1 and r.n_pieces == r.max_word_pieces
            continue
        text = "a" if r.doc_id is None else texts[r.doc_id] or ""
        words = pattern.findall(unicodedata.normalize("NFC", text).lower())
        pieces = [greedy((*w.encode(), T.END), known) for w in words]
        assert (r.n_words, r.n_pieces, r.max_word_pieces) == (len(words), sum(pieces), max(pieces, default=0))
    assert T.count_tokens(df.limit(0), PATH).count() == 0
