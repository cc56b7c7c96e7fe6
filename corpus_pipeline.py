"""Training-data pipeline: five stages over ``documents``, each an operator of ``ledgerlight.llm``.

Every stage reads what its predecessor kept.  All but the last return the
columns of documents.  Rows that repeat a doc_id are one document and share
its fate; rows without doc_id are only judged by their own text (toxicity,
encoding), as nothing else can name them.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, decontaminate, near_dedup, suffix_dedup, toxicity
from ledgerlight.llm.common import bound_batches, staged

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near copies share this share of their shingles of so many words (op3 has its own).
SHINGLE = 5
PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    bound_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.grade(model, F.col("text"))["p_toxic"] < model.cut)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    bound_batches(spark)
    found = near_dedup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go; characters cut in half go with them."""
    bound_batches(spark)

    @F.pandas_udf("string")
    def as_text(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.cut_repeats(docs, carry=rest)
    out = cut.withColumns({"text": as_text("kept"), **{c: F.col("carried").getField(c) for c in rest}})
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    bound_batches(spark)
    found = decontaminate.hit_digests(
        decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    gone = found.where(F.col("contaminated") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), their number and digest, digest of the decoded bytes."""
    bound_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    return bpe.token_digests(docs, path, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can't express the toxicity model; the stages have tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
