"""Quality rules with risk-controlled thresholds.

A rule rejects a document if a signal of its text is above the cutoff of the
document's stratum (its language).  Cutoffs come from labelled documents: for
every stratum, signal and value of a fixed grid, from the most lenient to the
strictest, the hypothesis "the rule rejects more than ``risk / signals`` of
the good documents" is tested by the exact binomial tail, which is the same
as comparing the Clopper-Pearson upper bound with that risk.  The strictest
cutoff before the first failing test is taken (fixed-sequence testing, so
the grid costs no further correction); Bonferroni covers strata and signals.
With probability ``1 - delta`` all rules together falsely reject at most
``risk`` of the good documents of each stratum.  A stratum with too few
labels to certify anything gets no cutoff, and its documents are judged by
the base rules alone.

Everything is built-in expressions.  Counts of a text are row-local (whole
texts, no explode), the calibration is one aggregate with map-side combine.

Defined cases: a null or empty text has no words and fails the base rule;
rows are judged one by one, so repeated rows stay; null strata are a stratum
of their own; empty tables give empty results; only the named columns are
read, so clashing names of others don't matter; a document with several
labels counts with its lowest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import let, staged

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Signal -> grid of cutoffs, most lenient first.
GRIDS = {
    "symbol_ratio": (0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04),
    "bang_ratio": (0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04),
    "upper_ratio": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20),
    "dup_line_ratio": (0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25),
    "repeat_ratio": (0.49, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10),
}
RISK = 0.05
DELTA = 0.05
MIN_WORDS = 50


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""
    def covered(starts: Column) -> Column:
        n = F.size(starts)
        gaps = F.transform(F.slice(starts, 1, F.greatest(n - 1, F.lit(0))),
                           lambda s, i: F.least(F.lit(3), F.get(starts, i + 1) - s))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, g: a + g))

    def starts(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return let(tagged, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["w"] == x["w"]))
                     | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))), lambda x: x["i"])))

    def of(windows: Column) -> Column:
        return (F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0))
                .otherwise(let(starts(windows), covered)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(
            " ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), of))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the base counts and the further counts that the signals need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                       F.col(text_col).cast("string").alias("text"))
    bare = F.regexp_replace(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = base.select(
        "doc_id", "stratum",
        let(bare, lambda b: F.struct(
            F.length(b).alias("word_chars"),
            (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).alias("n_symbols"),
            (F.length(b) - F.length(F.translate(b, "!", ""))).alias("n_bangs"),
            (F.length(b) - F.length(F.regexp_replace(b, r"\p{Lu}+", ""))).alias("n_upper"))).alias("c"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        let(words, lambda w: F.struct(
            F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"))
    return counts.select("doc_id", "stratum", *[F.col(c).cast("long").alias(c.split(".")[1]) for c in (
        "w.n_words", "c.word_chars", "c.n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        "c.n_bangs", "c.n_upper", "l.n_lines")])


def signals() -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "bang_ratio": ratio("n_bangs", "word_chars"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    series = (1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
              - 1 / (1680 * F.pow(y, F.lit(7))))
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) at rate p, exactly: the terms from k downwards.  1 from the mean on."""
    n, k = n.cast("double"), k.cast("long")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1.0) - log_gamma(n - k + 1) + k * math.log(p)
                + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    down = F.aggregate(
        F.sequence(k, F.lit(0).cast("long")), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * i / (n - i + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * down)


def calibrate(labelled: DataFrame, grids: dict[str, tuple] = GRIDS, risk: float = RISK,
              delta: float = DELTA) -> DataFrame:
    """(stratum, signal, cutoff): the certified cutoffs.

    ``labelled`` has stratum, good (1 or 0) and the signals as columns.  The
    table is bounded: strata with too few labels to certify a cutoff that
    rejects no good document drop out, so there are at most
    ``labels / n_min`` strata.
    """
    each = risk / len(grids)
    n_min = math.ceil(math.log(delta) / math.log1p(-each))
    # how often each cell of the grid rejects a good document: one aggregate
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"),
                      F.col(f"k_{s}_{i}").alias("k")) for s, g in grids.items() for i, c in enumerate(g)]
    sums = [F.sum((F.col(s) > c).cast("long")).alias(f"k_{s}_{i}") for s, g in grids.items() for i, c in enumerate(g)]
    counts = (labelled.where(F.col("good") == 1).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
              .where(F.col("n") >= n_min).select("stratum", "n", F.inline(F.array(*cells))))
    strata = F.count(F.lit(1)).over(Window.partitionBy("signal", "step"))
    tested = counts.withColumn("strata", strata).withColumn(
        "fails", (binomial_tail(F.col("k"), F.col("n"), each) > delta / (F.col("strata") * len(grids))).cast("int"))
    ordered = Window.partitionBy("stratum", "signal").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (tested.withColumn("fails", F.max("fails").over(ordered)).where("fails = 0")
            .groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff")))


def apply_rules(counts: DataFrame, cutoffs: DataFrame, grids: dict[str, tuple] = GRIDS) -> DataFrame:
    """Adds base_failed, failed_rules and kept.  ``cutoffs`` is bounded (see ``calibrate``) and broadcast."""
    wide = cutoffs.groupBy(F.col("stratum").alias("cut_stratum")).agg(
        *[F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in grids])
    s = signals()
    failed = F.array_compact(F.array(*[F.when(s[x] > F.col(f"cut_{x}"), F.lit(x)) for x in grids]))
    return (counts.join(F.broadcast(wide), F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
            .withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def quality_rules(docs: DataFrame, labels: DataFrame, good_col: str = "quality", risk: float = RISK,
                  delta: float = DELTA) -> DataFrame:
    """Judges every document; ``labels`` has doc_id and ``good_col``."""
    counts = staged(text_counts(docs), "counts")
    good = (labels.select("doc_id", F.col(good_col).alias("good")).where(F.col("good").isNotNull())
            .groupBy("doc_id").agg(F.min("good").alias("good")))
    labelled = counts.join(good, "doc_id").where(~base_failed()).select(
        "stratum", "good", *[c.alias(n) for n, c in signals().items()])
    return apply_rules(counts, calibrate(labelled, risk=risk, delta=delta))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """DuckDB's version of the query."""
    each = RISK / len(GRIDS)
    n_min = math.ceil(math.log(DELTA) / math.log1p(-each))
    grid = ", ".join(f"('{s}', {i}, {c!r})" for s, g in GRIDS.items() for i, c in enumerate(g))
    ratios = {"symbol_ratio": ("n_symbols", "word_chars"), "bang_ratio": ("n_bangs", "word_chars"),
              "upper_ratio": ("n_upper", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
              "repeat_ratio": ("n_repeat_words", "n_words")}
    signal = " UNION ALL ".join(
        f"SELECT r, stratum, doc_id, base_failed, '{s}' AS signal, CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS value FROM j"
        for s, (a, b) in ratios.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang::VARCHAR AS stratum, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT r, doc_id, stratum, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS b,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM c, unnest(range(1, greatest(0, len(w) - 2) + 1)) AS t(i)),
p AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM g, range(0, 3) AS q(o) WHERE n > 1 GROUP BY r),
k AS (
  SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(b)::BIGINT AS word_chars,
         (length(b) - length(translate(b, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(b) - length(replace(b, '!', '')))::BIGINT AS n_bangs,
         (length(b) - length(regexp_replace(b, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM c LEFT JOIN p USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k),
s AS ({signal}),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid(signal, step, cutoff) AS (VALUES {grid}),
cell AS (
  SELECT stratum, signal, step, cutoff, count(*) AS n, count(*) FILTER (WHERE value > cutoff) AS k
  FROM s JOIN good USING (doc_id) JOIN grid USING (signal) WHERE good = 1 AND NOT base_failed
  GROUP BY ALL HAVING count(*) >= {n_min}),
tail AS (
  SELECT *, CASE WHEN k >= n * {each!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each!r}) + (n - i) * ln(1 - {each!r})))) END AS p,
         count(*) OVER (PARTITION BY signal, step) AS strata
  FROM cell),
test AS (
  SELECT *, max(CASE WHEN p > {DELTA} / (strata * {len(GRIDS)}) THEN 1 ELSE 0 END)
            OVER (PARTITION BY stratum, signal ORDER BY step) AS fails FROM tail),
cut AS (SELECT stratum, signal, min(cutoff) AS cutoff FROM test WHERE fails = 0 GROUP BY ALL),
bad AS (
  SELECT DISTINCT r FROM s JOIN cut ON s.stratum IS NOT DISTINCT FROM cut.stratum AND s.signal = cut.signal
  WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.r IS NULL AS kept
FROM j LEFT JOIN bad USING (r)
"""


OP7_SQL = _sql()
