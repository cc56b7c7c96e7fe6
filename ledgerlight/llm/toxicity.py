"""Toxicity grades by cumulative-link ordinal regression.

The model has one weight for each sparse text feature and one threshold
between any two neighbouring grades: P(grade >= k) = sigmoid(weights . x -
threshold_k).  The weights are shared by all thresholds.  The output is the
expected severity, the sum of those probabilities, and P(grade >= 1), which
decides, by a cut that lets 99.9 % of the clean sampled rows be.

Features are words (A-Z lower-cased) and the first 4, 5 and 6 bytes of longer
words, by their CRC; a value is log(1 + number of occurrences).  The fit takes a
bounded sample of labelled rows (``per_class`` of each label), keeps at most
``max_features`` features that at least ``min_docs`` sampled rows have, and
minimises the weighted negative log-likelihood with an L1 penalty by proximal
steps, so most weights are exactly zero.  Where labels are only 0 and 1,
``severity_grades`` splits the toxic rows by how much of their text is words
that the sample has almost only in toxic rows.

Scoring reads each row once, whole, and needs no shuffle; the model has a
bounded size.

Defined cases: a null or empty text has no features and gets the score of an
empty text; repeated rows are scored one by one; null ids stay null; without
labels of both kinds nothing is learnt and every text gets severity 0; an
empty table gives an empty result; all columns of the input are kept by
``score`` and only the text is read, so a column may have any name but the
two it adds, which replace columns of their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import labelled_sample, staged, text_slices
from ledgerlight.llm.decontaminate import words_of

PER_CLASS = 3000
MAX_FEATURES = 20_000
MIN_DOCS = 5
PREFIXES = (4, 5, 6)
GRADES = 4
L1 = 5e-5
STEPS = 600
#: The rejecting P(grade >= 1) lies between these; within them it lets this share of clean sampled rows be.
THRESHOLDS = (0.4, 0.5)
CLEAN_SHARE = 0.999
#: A feature marks toxic text if this share of its sampled rows is toxic.
MARKER_SHARE = 0.9
KEPT_WORDS = 80_000


def features_of(word: bytes) -> list[int]:
    """The word and its beginnings, as CRCs."""
    return [zlib.crc32(word), *[zlib.crc32(word[:n] + b"*") for n in PREFIXES if len(word) > n]]


@dataclass
class Model:
    thresholds: list[float]
    weights: dict[int, float]
    cut: float = THRESHOLDS[1]
    _words: dict[bytes, tuple] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"thresholds": self.thresholds, "weights": self.weights, "cut": self.cut, "_words": {}}

    def _weighted(self, word: bytes) -> tuple:
        """The features of a word that have a weight."""
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= KEPT_WORDS:
                self._words.clear()
            found = self._words[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found

    def linear(self, text: str | None) -> float:
        from math import log1p

        counts: Counter = Counter()
        for word in words_of(text):
            found = self._weighted(word)
            if found:
                counts.update(found)
        return sum(self.weights[f] * log1p(n) for f, n in counts.items())

    def probabilities(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        from math import exp

        x = self.linear(text)
        return [1 / (1 + exp(min(500.0, t - x))) for t in self.thresholds]


def fit_ordinal(rows, columns, values, grades, weights, n_features: int, n_grades: int = GRADES, l1: float = L1,
                steps: int = STEPS):
    """(thresholds, feature weights) of a sparse matrix given by its entries; numpy, on one machine.

    ``weights`` are the rows' weights.  Accelerated proximal gradient; the
    thresholds are kept in order by writing them as a first one and steps.
    """
    import numpy as np

    n = len(grades)
    scale = weights / weights.sum()
    # the step of each coordinate from a bound of its curvature
    row_size = np.bincount(rows, np.abs(values), n)
    curve = np.bincount(columns, scale[rows] * np.abs(values) * row_size[rows], n_features) * (n_grades - 1) / 4
    step = 1 / np.maximum(curve, 1e-4)
    share = np.array([scale[grades >= k].sum() for k in range(1, n_grades)]).clip(1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(n_grades - 1))
    w = np.zeros(n_features)
    look_w, look_t, momentum = w.copy(), theta.copy(), 1.0
    above = np.stack([grades >= k for k in range(1, n_grades)], axis=1).astype(float)

    for _ in range(steps):
        x = np.bincount(rows, values * look_w[columns], n)
        # each threshold is a logistic model with the shared weights
        error = 1 / (1 + np.exp(np.clip(look_t[None, :] - x[:, None], -50, 50))) - above
        grad = np.bincount(columns, (scale * error.sum(1))[rows] * values, n_features)
        moved = look_w - step * grad
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_t = np.maximum.accumulate(look_t + 2.0 * (scale[:, None] * error).sum(0))
        following = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        beta = (momentum - 1) / following
        look_w, look_t = new_w + beta * (new_w - w), new_t + beta * (new_t - theta)
        w, theta, momentum = new_w, new_t, following
    return theta, w


def severity_grades(toxic, marker_share, n_grades: int = GRADES):
    """Grades of rows labelled 0 or 1: toxic rows by the quantile of their share of marker words."""
    import numpy as np

    grades = np.asarray(toxic, dtype=int).copy()
    own = marker_share[grades == 1]
    if len(own) and n_grades > 2:
        cuts = np.quantile(own, np.arange(1, n_grades - 1) / (n_grades - 1))
        grades[grades == 1] = 1 + np.searchsorted(cuts, own, side="right")
    return grades


def _sampled_features(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """label, weight, n_words, features and counts of the sampled rows."""
    kind = "doc_id string, label int, weight double, n_words long, features array<long>, counts array<int>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_slices(batches, "text", 4 << 20):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            found = []
            for w in words:
                counts: Counter = Counter()
                for word, n in Counter(w).items():
                    for f in features_of(word):
                        counts[f] += n
                found.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), batch.column("weight"),
                 pa.array([len(w) for w in words], pa.int64()), pa.array([[*c] for c in found], pa.list_(pa.int64())),
                 pa.array([[*c.values()] for c in found], pa.list_(pa.int32()))],
                ["doc_id", "label", "weight", "n_words", "features", "counts"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return joined.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "weight", "text").mapInArrow(run, kind)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS,
        max_features: int = MAX_FEATURES, n_grades: int = GRADES) -> Model:
    """Fit on at most ``per_class`` rows of each label; what reaches the driver is bounded by that sample."""
    import numpy as np

    sample = staged(labelled_sample(labels, label_col, per_class), "sample")
    table = staged(_sampled_features(docs, sample), "features")
    seen = table.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    totals = table.agg(F.count(F.lit(1)), F.sum("label")).first()
    n_rows, n_toxic = totals[0], totals[1] or 0
    if not 0 < n_toxic < n_rows:
        return Model([50.0] * (n_grades - 1), {})
    expected = F.col("n") * (n_toxic / n_rows)
    score = F.abs(F.col("toxic") - expected) / F.sqrt(expected * (1 - n_toxic / n_rows) + 1e-9)
    chosen = seen.where(F.col("n") >= MIN_DOCS).orderBy(score.desc(), "feature").limit(max_features)
    kept = chosen.select("feature", (F.col("toxic") >= MARKER_SHARE * F.col("n")).alias("marker")).collect()
    number = {r[0]: i for i, r in enumerate(sorted(kept))}
    marker = np.array([r[1] for r in sorted(kept)], dtype=bool)

    rows, columns, values, toxic, weight, share = [], [], [], [], [], []
    spread = F.arrays_zip(F.col("features").alias("f"), F.col("counts").alias("c"))
    wanted = table.select("doc_id", "label", "weight", "n_words", F.explode(spread).alias("e")).select(
        "doc_id", "label", "weight", "n_words", F.col("e.f").alias("feature"), F.col("e.c").alias("n"))
    short = (wanted.join(F.broadcast(chosen.select("feature")), "feature").groupBy("doc_id")
             .agg(F.collect_list("feature").alias("f"), F.collect_list("n").alias("c")))
    full = table.select("doc_id", "label", "weight", "n_words").join(short, "doc_id", "left")
    found = []  # packed as they come: the rows of the sample never lie in the driver as objects
    for r in full.toLocalIterator():
        at = np.fromiter((number[f] for f in r["f"] or ()), np.int32, len(r["f"] or ()))
        found.append((r["doc_id"], at, np.array(r["c"] or (), dtype=np.float32), r["label"], r["weight"], r["n_words"]))
    for i, (_, at, n, label, scale, n_words) in enumerate(sorted(found, key=lambda x: x[0])):
        order = np.argsort(at)
        at, n = at[order], n[order]
        rows.append(np.full(len(at), i, dtype=np.int32))
        columns.append(at)
        values.append(np.log1p(n))
        toxic.append(label)
        weight.append(scale)
        share.append(n[marker[at]].sum() / max(1, n_words))
    grades = severity_grades(np.array(toxic), np.array(share), n_grades)
    at, of, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    theta, w = fit_ordinal(at, of, value, grades, np.array(weight), len(number), n_grades)
    p = 1 / (1 + np.exp(np.clip(theta[0] - np.bincount(at, value * w[of], len(grades)), -50, 50)))
    cut = float(np.clip(np.quantile(p[grades == 0], CLEAN_SHARE), *THRESHOLDS))
    return Model(theta.tolist(), {f: float(w[i]) for f, i in number.items() if w[i] != 0}, cut)


def grade(model: Model, text: Column) -> Column:
    """A struct of severity (expected grade) and p_toxic (probability of any grade above 0) of a text column."""
    @F.pandas_udf("severity double, p_toxic double", functionType=F.PandasUDFType.SCALAR)
    def graded(texts):
        found = [model.probabilities(t) for t in texts]
        return pd.DataFrame({"severity": [float(sum(p)) for p in found], "p_toxic": [float(p[0]) for p in found]})

    return graded(text.cast("string"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with severity and p_toxic, which replace columns of these names."""
    graded = grade(model, F.col(text_col))
    return docs.withColumns({"severity": graded["severity"], "p_toxic": graded["p_toxic"]})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= model.cut).alias("rejected"))
