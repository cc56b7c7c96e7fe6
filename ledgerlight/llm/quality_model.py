"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is
encoded from its own text (shares of kinds of characters, lengths and
repetition of its words) by one tanh layer; a gated attention
``softmax(u . (tanh(V h) * sigmoid(G h)))`` weighs the passages of the bag, and
a logistic layer scores the weighted mean.  Only documents have labels; which
passages matter is learnt through the attention.

The fit takes a bounded sample of labelled documents (``per_class`` of each
label), weighted back to the shares of all labelled rows, and runs Adam over
all its passages.  Scoring reads every passage of every text, in slices of a
bounded number of bytes, without a shuffle.  The score depends on the text alone.

Defined cases: a null or empty text is a bag of one passage without words;
repeated rows are scored one by one; null ids stay null; without labels of
both kinds every text scores the share of label 1, or 0.5 without labels; an
empty table gives an empty result; all columns of the input are kept by
``score`` and only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import labelled_sample, staged, text_slices

PASSAGE = 48
PER_CLASS = 2000
HIDDEN = 12
GATE = 8
STEPS = 250
RATE = 0.02
DECAY = 1e-4
CUT = 0.3
HELD_OUT = 5
SEED = 7
SLICE_BYTES = 2 << 20

#: Kinds of bytes whose shares describe a passage.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
         "stop": b".,;:?", "bang": b"!", "pipe": b"|", "sign": b"#*$%&<>@=+~^_\\/{}[]",
         "quote": b"\"'()-", "line": b"\n", "far": bytes(range(128, 256))}
FEATURES = (*KINDS, "word_length", "longest", "short", "same_as_last", "distinct", "size")


def passage_features(texts: list[str | None]):
    """(features of all passages of all texts, first passage of each text); float32, one row a passage.

    Every text has at least one passage, of zeros if it has no words.
    """
    import numpy as np

    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    ends = np.cumsum(lengths)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    doc = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(passages) - passages
    out = np.zeros((int(passages.sum()), len(FEATURES)), dtype=np.float32)
    if not len(starts):
        return out, first
    within = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[doc]
    passage = first[doc] + within // PASSAGE
    cut = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])  # first word of each passage with words
    has = passage[cut]
    words = np.diff(np.r_[cut, len(starts)])

    # sizes: up to the next blank
    blanks = np.flatnonzero(blank)
    size = blanks[np.searchsorted(blanks, starts)] - starts
    kind = np.zeros(256, dtype=np.uint8)
    for i, chars in enumerate(KINDS.values(), 1):
        kind[np.frombuffer(chars, dtype=np.uint8)] = i
    kinds = kind[data]
    # line ends before a text's first word, and those put between texts, are nobody's
    kinds[ends - 1] = 0
    first_word = np.full(len(texts), len(data))
    first_word[doc[::-1]] = starts[::-1]
    lines = np.flatnonzero(kinds == 1 + [*KINDS].index("line"))
    kinds[lines[lines < first_word[np.searchsorted(ends, lines, side="right")]]] = 0
    begin = starts[cut]
    span = np.diff(np.r_[begin, len(data)])
    of_passage = np.repeat(np.arange(len(cut)), span)
    table = np.bincount(of_passage * 16 + kinds[begin[0]:], minlength=16 * len(cut)).reshape(-1, 16)
    letters = np.maximum(1, np.add.reduceat(size, cut))
    out[has, :len(KINDS)] = table[:, 1:len(KINDS) + 1] / letters[:, None]

    # a hash of each word, for repetition
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = np.where(blank, 0, data.astype(np.uint64) + np.uint64(1)) * power[place & 255]
    sums = np.add.reduceat(value, starts) * np.uint64(0xC4CEB9FE1A85EC53)
    same = np.r_[False, (sums[1:] == sums[:-1])] & (within % PASSAGE > 0)
    mixed = (sums ^ (sums >> np.uint64(29))) + passage.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed)
    fresh = np.r_[True, mixed[order][1:] != mixed[order][:-1]]
    distinct = np.bincount(passage[order[fresh]], minlength=len(out))[has]

    mean = np.add.reduceat(size, cut) / words
    out[has, -6] = np.minimum(mean, 40) / 10
    out[has, -5] = np.minimum(np.maximum.reduceat(size, cut), 80) / 20
    out[has, -4] = np.add.reduceat((size <= 2).astype(np.int64), cut) / words
    out[has, -3] = np.add.reduceat(same.astype(np.int64), cut) / words
    out[has, -2] = distinct / words
    out[has, -1] = words / PASSAGE
    return out, first


@dataclass
class Model:
    mean: object
    scale: object
    weights: dict | None
    base: float

    def score(self, features, first):
        """One score a bag; ``first`` are the bags' first passages."""
        import numpy as np

        if self.weights is None:
            return np.full(len(first), self.base)
        return forward(self.weights, (features - self.mean) / self.scale, first)["p"]


def forward(w: dict, x, first) -> dict:
    import numpy as np

    counts = np.diff(np.r_[first, len(x)])
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"] + w["v"]), 1 / (1 + np.exp(-(h @ w["G"] + w["g"])))
    s = (t * g) @ w["u"]
    s = s - np.repeat(np.maximum.reduceat(s, first), counts)
    a = np.exp(s)
    a = a / np.repeat(np.add.reduceat(a, first), counts)
    z = np.add.reduceat(a[:, None] * h, first)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "counts": counts}


def gradients(w: dict, x, first, y, weight) -> dict:
    """Of the weighted mean log loss."""
    import numpy as np

    f = forward(w, x, first)
    d = (f["p"] - y) * weight / weight.sum()
    dz = d[:, None] * w["c"]
    bag = np.repeat(np.arange(len(first)), f["counts"])
    dzp, zp = dz[bag], f["z"][bag]
    ds = f["a"] * ((f["h"] - zp) * dzp).sum(1)
    dtg = ds[:, None] * w["u"]
    dt = dtg * f["g"] * (1 - f["t"] ** 2)
    dg = dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dzp + dt @ w["V"].T + dg @ w["G"].T
    de = dh * (1 - f["h"] ** 2)
    return {"E": x.T @ de, "e": de.sum(0), "V": f["h"].T @ dt, "v": dt.sum(0), "G": f["h"].T @ dg, "g": dg.sum(0),
            "u": ((f["t"] * f["g"]) * ds[:, None]).sum(0), "c": (f["z"] * d[:, None]).sum(0), "b": d.sum()}


def fit_attention(features, first, y, weight, steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam over the whole sample; numpy, on one machine."""
    import numpy as np

    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = ((features - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    k = x.shape[1]
    w = {"E": rng.normal(0, k ** -0.5, (k, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "v": np.zeros(GATE),
         "G": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "g": np.zeros(GATE),
         "u": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b": np.zeros(())}
    m, v = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        rate = RATE * min(1.0, 2 * (1 - (i - 1) / steps))
        for n, grad in gradients(w, x, first, y, weight).items():
            grad = grad + DECAY * w[n]
            m[n] = 0.9 * m[n] + 0.1 * grad
            v[n] = 0.999 * v[n] + 0.001 * grad ** 2
            w[n] = w[n] - rate * (m[n] / (1 - 0.9 ** i)) / (np.sqrt(v[n] / (1 - 0.999 ** i)) + 1e-8)
    return Model(mean, scale, w, float(np.average(y, weights=weight)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", keep=None,
        per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` documents of each label that ``keep`` (a condition on doc_id) allows."""
    import numpy as np

    sample = staged(labelled_sample(labels, label_col, per_class, keep), "sample")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_slices(batches, "text", SLICE_BYTES):
            if batch.num_rows:
                x, first = passage_features(batch.column("text").to_pylist())
                bags = np.split(x, first[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("label"), batch.column("weight"),
                     pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())],
                    ["doc_id", "label", "weight", "bag"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    bags = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "weight", "text").mapInArrow(
        run, "doc_id string, label int, weight double, bag binary")
    rows = sorted(bags.collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    y, weight = np.array([r["label"] for r in rows], dtype=float), np.array([r["weight"] for r in rows])
    if not rows or y.min() == y.max():
        return Model(None, None, None, float(y[0]) if rows else 0.5)
    x = [np.frombuffer(r["bag"], dtype="<f4").reshape(-1, len(FEATURES)) for r in rows]
    sizes = np.array([len(b) for b in x])
    return fit_attention(np.concatenate(x), np.cumsum(sizes) - sizes, y, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the column score, from 0 to 1."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        import numpy as np

        values = texts.tolist()
        sizes = np.cumsum([len(t or "") for t in values])
        out, start = [], 0
        while start < len(values):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
            out.append(model.score(*passage_features(values[start:stop])))
            start = stop
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col).cast("string")))


def held_out():
    """A fifth of all ids, never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(HELD_OUT)) == 0,
                      F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))
