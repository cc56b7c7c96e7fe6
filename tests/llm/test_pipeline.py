"""The pipeline on a small folder of tables: each stage judged on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from ledgerlight.llm import bpe
from ledgerlight.llm.common import run_folder


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.25
        t = text(rng.randint(40, 120))
        docs.append((i, t + " zounds zwicker" * 3 if toxic else t))
        labels.append((i, 1, int(toxic)))
    shared, item = text(70), text(30)
    docs += [(1000, text(100)), (1001, shared + " " + text(60)), (1002, text(60) + " " + shared + " ü"),
             (1003, text(10) + " " + item + " " + text(20)), (1004, None), (1005, ""), (None, text(50))]
    docs += [(1010, docs[400][1]), (1011, docs[400][1].replace(" ", "  ", 3)), (1010, docs[400][1])]
    path = run_folder(spark, "pipeline-test")
    (spark.createDataFrame(docs, "doc_id long, text string")
     .selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars",
                 "'keep' as kept", "2.5D as p_toxic").write.parquet(f"{path}/documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d: t for d, t in docs}, {d for d, _, t in labels if t}


def test_stages(spark, folder):
    path, texts, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "byte_bpe"]
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, path)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(f"{path}/out-{name}")
        seen[name] = docs = spark.read.parquet(f"{path}/out-{name}")
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}

    gone = set(texts) - ids["toxicity"]
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 2
    assert ids["toxicity"] - ids["near_dedup"] == {1010, 1011}
    row = {r.doc_id: r for r in seen["suffix_dedup"].collect()}
    assert ids["suffix_dedup"] == ids["near_dedup"]
    assert len(row[1002].text) < len(texts[1002]) - 300 and row[1001].text == texts[1001]
    assert row[1002].n_chars == len(row[1002].text) and (row[1002].kept, row[1002].p_toxic) == ("keep", 2.5)
    assert row[1004].text == "" and row[None].text == texts[None]
    assert ids["suffix_dedup"] - ids["decontamination"] == {1003}
    last = {r.doc_id: r for r in docs.collect()}
    for i in (1002, 1004, None):
        assert bpe.decode_ids(bytes(last[i].ids), C.public_tokenizers.path(C.VOCABULARY),
                              C.public_tokenizers.PATTERN) == row[i].text.encode()


def test_run_equals_its_stages(spark, folder):
    path, *_ = folder
    a = C.run(spark, path).select("doc_id", "ids_sha256").collect()
    b = spark.read.parquet(f"{path}/out-byte_bpe").select("doc_id", "ids_sha256").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_empty_documents(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.lit(False))
    for _, stage in C.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
