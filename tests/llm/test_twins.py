"""The DuckDB twins of the corpus queries against the queries, on small tables with nulls, ties and copies."""

import random

import duckdb
import pytest

from ledgerlight.llm import queries as Q

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def _tables():
    rng = random.Random(17)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "dé", "e1", "#x", "|", "the", "of", f"w{rng.randrange(900)}"])
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), text(9)
    texts = [None, "", " \n ", "one", "one two three", passage, passage + " " + text(5), "a b c " * 30]
    texts += [rng.choice(["", passage + " "]) + text(rng.randint(1, 90)) + rng.choice(["", f"\n{line}\n{line}"]) for _ in range(50)]
    base = text(120).split()
    for _ in range(12):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[20], texts[20], texts[30].upper()]
    docs = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    html = ["<p>" + text(400) + "</p>", None, "", "<i>short</i>"]
    urls = ["http://www.Example.org/es/x?q", "https://example.org/en/12", "http://a.com/fr/b", "http://x.com/de/", "ftp://é.org/",
            "no scheme", None, "http://b.net/promo/click?ad=1", "http://example.org/en/1#f", "http://com/fr/"]
    pages = [(i, urls[i % len(urls)], html[i % 4]) for i in range(60)]
    bench = [(1, text(20)), (2, passage), (3, None), (4, "..."), (5, "one two three"), (None, passage)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(len(texts))] + [(None, 1, 1), (3, None, None)]
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    emb = [(i, v, rng.choice([0, 1, None])) for i, v in enumerate(vectors)]
    emb += [(400, None, 1), (401, [float("nan")] + [0.0] * 7, 1), (402, vectors[3], 2), (403, [None] + [1.0] * 7, 0)]
    return {"documents": docs, "pages": pages, "benchmark": bench, "labels": labels, "embeddings": emb}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("twins")
    for name, rows in _tables().items():
        spark.createDataFrame(rows, TABLES[name]).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_twin(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(Q.ORACLE[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted([_plain(r[i]) for i in at] for r in found.fetchall())
    df = Q.QUERIES[name](spark, folder)
    assert sorted(df.columns) == columns
    got = sorted([_plain(v) for v in r] for r in df.select(columns).collect())
    assert got == want
