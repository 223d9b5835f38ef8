"""Stored indexes against the same search without one, over versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.operators import fulltext, lexical, topk, vector_index
from mnemoria.operators.fulltext import FullText
from mnemoria.operators.vector_index import VectorIndex
from mnemoria.sources import versions


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("atomic_text")).cache()


@pytest.fixture(scope="module")
def questions(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).cache()


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_search_reads_what_a_scan_finds(spark, docs, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BUCKETS", 8)
    index = FullText.create(spark, f"{tmp_path}/i", docs)
    assert found(index.search(questions)) == found(lexical.bm25(docs, questions))
    assert found(index.search(questions, k=3, pilot=1)) == found(lexical.bm25(docs, questions, k=3))


def test_versions_of_the_text_index(spark, docs, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BUCKETS", 4)
    docs, asked = docs.filter("id < 60"), questions.filter("query_id < 12")
    first = FullText.create(spark, f"{tmp_path}/i", docs.filter("id < 40"))
    more = spark.createDataFrame([(3, "thion onth thion"), (900, "onth"), (901, None), (902, ""), (None, "gone"), (903, "b"), (903, "a tie of two rows")], "id long, atomic_text string")
    second = first.append(docs.filter("id >= 40")).append(more)
    now = docs.filter("id <> 3").unionByName(more.filter("id is not null and not (id = 903 and atomic_text = 'b')")).fillna("", ["atomic_text"])
    assert found(second.search(asked)) == found(lexical.bm25(now, asked))
    third = second.delete(spark.createDataFrame([(900,), (7,), (12345,)], "id long"))
    now = now.filter("id not in (900, 7)")
    assert found(third.search(asked)) == found(lexical.bm25(now, asked))
    merged = third.merge()
    assert len(merged.about["segments"]) == 1 and merged.dead().isEmpty()
    assert found(merged.search(asked)) == found(lexical.bm25(now, asked))
    again = merged.append(spark.createDataFrame([(7, "onth thion")], "id long, atomic_text string"))
    assert again.live().filter("id = 7").count() == 1
    assert found(FullText(spark, f"{tmp_path}/i", first.version).search(asked)) == found(lexical.bm25(docs.filter("id < 40"), asked))
    assert versions.numbers(spark, f"{tmp_path}/i") == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="another writer"):
        first.delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(ValueError, match="no version"):
        FullText(spark, f"{tmp_path}/i", 99)


def test_windows_that_cannot_win_stay_shut(spark, tmp_path, monkeypatch):
    """Short documents that name the word often win; windows of long ones are not opened."""
    monkeypatch.setattr(fulltext, "BUCKETS", 4)
    rows = [(i, "apple " * 3) for i in range(20)] + [(i, "apple " + "filler " * (50 + i)) for i in range(20, 1500)]
    docs, asked = spark.createDataFrame(rows, "id long, atomic_text string"), spark.createDataFrame([(1, "apple"), (2, "nothing like it")], "query_id int, query string")
    index = FullText.create(spark, f"{tmp_path}/i", docs)
    said = index.opened(asked, k=5).collect()
    assert [r["query_id"] for r in said] == [1]
    assert said[0]["opened"] < said[0]["windows"] / 2
    assert found(index.search(asked, k=5)) == found(lexical.bm25(docs, asked, k=5))


def test_empty_text_index(spark, questions, tmp_path):
    index = FullText.create(spark, f"{tmp_path}/i", spark.createDataFrame([], "id long, atomic_text string"))
    assert index.search(questions).count() == 0
    assert index.append(spark.createDataFrame([(1, "onth")], "id long, atomic_text string")).stats() == (1, 1.0)


def clusters(n, d=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(i, (c[i % centres] + 0.5 * rng.normal(size=d)).tolist()) for i in range(n)]


VECTORS = "id long, embedding array<double>"


def recall(found, exact):
    want = {(r["query_id"], r["id"]) for r in exact.collect()}
    return len(want & {(r["query_id"], r["id"]) for r in found.collect()}) / len(want)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clusters(1500), VECTORS).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(clusters(40, seed=1), "query_id long, query array<double>").cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex.create(spark, f"{tmp_path_factory.mktemp('ann')}/i", vectors, nlist=24, m=4, bits=6, train_min=500, model="a")


def test_two_stages_find_what_is_near(spark, vectors, asked, index):
    exact = topk.exact_topk(vectors, asked, 10)
    got = index.search(asked, k=10)
    assert recall(got, exact) >= 0.9
    assert {(r["query_id"], r["id"]): round(r["score"], 5) for r in got.collect()}.items() <= {(r["query_id"], r["id"]): round(r["score"], 5) for r in topk.exact_topk(vectors, asked, 1500).collect()}.items()
    unit = np.array([r["query"] for r in asked.collect()])
    probed = index.probes(unit / np.linalg.norm(unit, axis=1, keepdims=True)).sum(1)
    assert probed.mean() < 12 and len(set(probed.tolist())) > 1  # of 24 lists, and by query


def test_codes_are_those_of_a_plain_loop(index):
    rows = index.lists().limit(60).collect()
    centroids, books = np.array(index.about["centroids"]), [np.array(b) for b in index.about["books"]]
    for r in rows:
        x = np.array(r["embedding"], float)
        cluster = max(range(len(centroids)), key=lambda c: (round(float(x @ centroids[c]), 9), -c))
        left = x - centroids[cluster]
        codes = [min(range(len(b)), key=lambda e: (((left[4 * j : 4 * j + 4] - b[e]) ** 2).sum(), e)) for j, b in enumerate(books)]
        assert (r["cluster"], list(r["codes"])) == (cluster, codes)
        assert r["residual_norm"] == pytest.approx(np.linalg.norm(left), rel=1e-5)


def test_versions_of_the_vector_index(spark, vectors, asked, index):
    new = spark.createDataFrame([(5, (np.ones(16)).tolist()), (9001, (np.ones(16) * 2).tolist()), (9002, [1.0]), (9003, None), (9004, [float("nan")] * 16), (9005, [0.0] * 16), (None, [1.0] * 16)], VECTORS)
    q = spark.createDataFrame([(0, np.ones(16).tolist())], "query_id long, query array<double>")
    grown = index.upsert(new)
    top = grown.search(q, k=2).orderBy("rank").collect()
    assert [r["id"] for r in top] == [5, 9001]
    assert grown.live().count() == 1502  # 9001 and 9005 came, 5 changed
    less = grown.delete(spark.createDataFrame([(5,)], "id long"))
    assert less.search(q, k=1).first()["id"] == 9001
    assert 5 not in {r["id"] for r in less.search(asked, k=50).collect()}
    assert VectorIndex(spark, index.path, index.version).live().count() == 1500
    assert less.maintain() is less
    far = less.upsert(spark.createDataFrame([(20_000 + i, x) for i, x in clusters(900, seed=77)], VECTORS))
    assert far.drift()[1] > 0.5
    fresh = far.maintain()
    assert fresh.version > far.version and len(fresh.about["parts"]) == 1 and fresh.dead().isEmpty()
    assert recall(fresh.search(asked), topk.exact_topk(fresh.live().select("id", "embedding"), asked, 10)) >= 0.9
    assert fresh.stats().agg(F.sum("n")).first()[0] == 2401
    with pytest.raises(ValueError, match="another index"):
        VectorIndex(spark, index.path, model="b", dimension=16)


def test_scan_where_lists_fall_short(spark, vectors, asked, index, tmp_path):
    few = VectorIndex.create(spark, f"{tmp_path}/few", vectors.filter("id < 50"), train_min=100)
    assert not few.trained
    exact = topk.exact_topk(vectors.filter("id < 50"), asked, 10)
    assert recall(few.search(asked), exact) == 1.0
    assert few.upsert(vectors.filter("id between 50 and 120")).trained
    assert index.search(asked.limit(3), k=1490).groupBy("query_id").count().filter("count = 1490").count() == 3
    none = VectorIndex.create(spark, f"{tmp_path}/none", vectors.limit(0))
    assert none.search(asked).count() == 0


def test_each_ablation_differs(spark, data):
    from mnemoria.catalogue import QUERIES

    names = ["adaptive_retrieve", *[n for n in QUERIES if n.startswith("ablation_")]]
    answers = [tuple(sorted(map(tuple, QUERIES[n](spark, data).collect()))) for n in names]
    assert len(names) == 5 and len(set(answers)) == 5
