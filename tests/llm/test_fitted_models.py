import math
import random

import numpy as np
import pytest

from ledgerlight.llm import quality_model as Q
from ledgerlight.llm import toxicity as X


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean and bad documents: toxic words or prefixes, and junk stretches inside prose."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        toxic, quality = int(rng.random() < 0.3), int(rng.random() < 0.7)
        for _ in range(toxic * rng.randint(1, 12)):
            words.insert(rng.randrange(len(words)), rng.choice(["zounds", "zwick" + rng.choice(vocabulary)]))
        if not quality:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(vocabulary)] * 40 if rng.random() < 0.5 else [w + " |" for w in words[:40]]
        docs.append((i, " ".join(words), "en"))
        if rng.random() < 0.8:
            labels.append((i, quality, toxic))
    extra = [(2000, None, None), (2001, "", "x"), (2001, "", "x"), (None, "zounds zounds", "en"), (2002, "word " * 60000, "en")]
    return (spark.createDataFrame(docs + extra, "doc_id long, text string, score string"),
            spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None), (5001, 1, 0)], "doc_id long, quality int, toxic int"),
            {i: (q, t) for i, q, t in labels})


def test_toxicity_held_out(spark, corpus):
    docs, labels, truth = corpus
    model = X.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = X.score(docs, model).collect()
    assert len(rows) == docs.count()
    unseen = [(r.p_toxic >= model.cut, truth[r.doc_id][1]) for r in rows if r.doc_id in truth and r.doc_id % 3 == 0]
    assert sum(a == bool(b) for a, b in unseen) / len(unseen) > 0.97
    assert all(0 <= r.severity <= X.GRADES - 1 and 0 <= r.p_toxic <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].p_toxic > 0.5 > by_id[2000].p_toxic == by_id[2001].p_toxic
    # more of it is more severe, and each threshold is passed less often than the one below
    few, many = model.probabilities("word zounds"), model.probabilities("zounds " * 12 + "zwicker zwickel")
    assert sum(many) > sum(few) and few == sorted(few, reverse=True)


def test_ordinal_weights_are_shared():
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    latent = x @ np.array([2.0, 1.0, 0.0]) + rng.logistic(size=n)
    grades = np.searchsorted([1.0, 2.5], latent)
    rows, cols = np.nonzero(x)
    theta, w = X.fit_ordinal(rows, cols, x[rows, cols], grades, np.ones(n), 3, 3, l1=0.0, steps=1500)
    assert np.allclose(w, [2, 1, 0], atol=0.25) and np.allclose(theta, [1, 2.5], atol=0.25)


def test_severity_grades():
    grades = X.severity_grades(np.array([0, 1, 1, 1, 0, 1]), np.array([0, .1, .2, .3, .9, .3]), 4)
    assert grades.tolist() == [0, 1, 2, 3, 0, 3] or grades.tolist() == [0, 1, 1, 3, 0, 3]


def test_nothing_to_learn(spark, corpus):
    docs, labels, _ = corpus
    model = X.fit(docs, labels.where("toxic = 0"))
    assert X.score(docs.limit(5), model).where("p_toxic > 1e-9").count() == 0
    flat = Q.fit(docs, labels.where("quality = 1"))
    assert Q.score(docs.limit(3), flat).where("score = 1").count() == 3
    assert Q.score(docs.limit(3), Q.fit(docs, labels.limit(0))).where("score = 0.5").count() == 3
    assert Q.score(docs.limit(0), flat).count() == X.score(docs.limit(0), model).count() == 0


def test_quality_held_out(spark, corpus):
    docs, labels, truth = corpus
    model = Q.fit(docs, labels, keep=~Q.held_out())
    rows = Q.score(docs, model).withColumn("held", Q.held_out()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    unseen = [(r.score, truth[r.doc_id][0]) for r in rows if r.held and r.doc_id in truth]
    assert len(unseen) > 150
    good, bad = [s for s, q in unseen if q], [s for s, q in unseen if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[2000] == by_id[2001]


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(5)
    x, first = rng.normal(size=(9, 4)), np.array([0, 2, 3, 7])
    y, weight = np.array([1, 0, 1, 0.0]), np.array([1, 2, 0.5, 1])
    w = {"E": rng.normal(size=(4, 3)), "e": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "v": rng.normal(size=2),
         "G": rng.normal(size=(3, 2)), "g": rng.normal(size=2), "u": rng.normal(size=2), "c": rng.normal(size=3),
         "b": rng.normal(size=())}

    def loss(m):
        p = Q.forward(m, x, first)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    for name, grad in Q.gradients(w, x, first, y, weight).items():
        for i in np.ndindex(np.shape(grad)):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][i] += 1e-6
            down[name][i] -= 1e-6
            assert np.asarray(grad)[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_passage_features_do_not_depend_on_neighbours():
    texts = ["One two, two!", "\n\n x\ny\n\n", "\n \n", "", None, "| a | b |", "ÄÖ ü " * 70, "same same same", " \n lead", "x" * 5000]
    x, first = Q.passage_features(texts)
    ends = [*first[1:], len(x)]
    for t, a, b in zip(texts, first, ends):
        alone, _ = Q.passage_features([t])
        assert np.allclose(alone, x[a:b]), t
    names = dict(zip(Q.FEATURES, x[first[7]]))
    assert names["same_as_last"] == pytest.approx(2 / 3) and names["distinct"] == pytest.approx(1 / 3)
    assert names["word_length"] == pytest.approx(0.4) and math.isclose(names["lower"], 1.0)
    assert len(Q.passage_features(["a " * 200])[0]) == -(-200 // Q.PASSAGE)


def test_training_with_shuffled_labels_learns_nothing():
    """The held-out score comes from the labels: with labels shuffled it is chance."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 600).astype(float)
    x = rng.normal(size=(1800, len(Q.FEATURES))).astype(np.float32)
    first = np.arange(0, 1800, 3)
    x[first + 1, 0] += 4 * y
    real = Q.fit_attention(x[:1200], first[:400], y[:400], np.ones(400), steps=150)
    fake = Q.fit_attention(x[:1200], first[:400], rng.permutation(y[:400]), np.ones(400), steps=150)
    auc = lambda s: np.mean(s[y[400:] == 1][:, None] > s[y[400:] == 0][None, :])
    assert auc(real.score(x[1200:], first[400:] - 1200)) > 0.9
    assert abs(auc(fake.score(x[1200:], first[400:] - 1200)) - 0.5) < 0.2
