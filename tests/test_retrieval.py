"""Retrieval against brute force, on small fixtures with hot groups and ties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankjobs.operators import blocks, bm25, dense, embed, fuse
from tests import twins

random.seed(3)
WORDS = [f"w{i}" for i in range(60)]


def texts(n):
    """A third of the texts are copies, one word is in all of them, one text is empty."""
    out = {}
    for i in range(n):
        out[i] = "common same words copy" if i % 3 == 0 else "common " + " ".join(random.choices(WORDS, k=random.randint(1, 30)))
    out[n] = ""
    return out


def vectors(n, dim=5):
    rng = np.random.default_rng(1)
    out = {}
    for i in range(n):
        v = np.ones(dim) if i % 3 == 0 else rng.normal(size=dim)
        out[i] = [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]
    out[n] = [0.0] * dim
    return out


@pytest.fixture(params=["broadcast", "grid"])
def route(request, monkeypatch):
    """Both ways for blocks to meet."""
    if request.param == "grid":
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", -1)
    return request.param


def lists(df, score, rank):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r[rank], r.bug_id, r[score]))
    for q, rows in out.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


@pytest.mark.parametrize("parts, block_rows", [(1, 1000), (7, 9)])
def test_bm25_self(spark, route, parts, block_rows):
    corpus = texts(70)
    df = spark.createDataFrame(list(corpus.items()), "bug_id bigint, t string").repartition(parts)
    index = bm25.build_index(df, "bug_id", "t", block_rows=block_rows)
    assert index.n_docs == len(corpus)
    got = lists(bm25.bm25_top_k(None, index, 6, exclude_self=True), "bm25_score", "bm25_rank")
    for q, text in corpus.items():
        want = twins.best(twins.bm25_scores(corpus, text), 6, skip=q)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)


def test_bm25_queries_count_repeats_and_ignore_unknown_words(spark, route):
    corpus = texts(40)
    df = spark.createDataFrame(list(corpus.items()), "bug_id bigint, t string")
    index = bm25.build_index(df, "bug_id", "t", block_rows=16)
    asked = {1: "w1 w1 w2 nowhere", 2: "nowhere at all", 3: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query_text string")
    got = lists(bm25.bm25_top_k(queries, index, 5), "bm25_score", "bm25_rank")
    for q, text in asked.items():
        want = twins.best(twins.bm25_scores(corpus, text), 5)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
    filled = lists(bm25.bm25_top_k(queries, index, 5, fill_zero=True), "bm25_score", "bm25_rank")
    assert [i for i, _ in filled[2]] == [0, 1, 2, 3, 4] and len(filled[1]) == 5


def test_bm25_sparse_and_dense_terms_agree(spark, monkeypatch):
    corpus = texts(60)
    df = spark.createDataFrame(list(corpus.items()), "bug_id bigint, t string")
    index = bm25.build_index(df, "bug_id", "t")
    usual = lists(bm25.bm25_top_k(None, index, 5), "bm25_score", "bm25_rank")
    monkeypatch.setattr(bm25, "MAX_DENSE_TERMS", 0)
    monkeypatch.setattr(bm25, "MAX_SPARSE_CHUNK", 50)
    assert lists(bm25.bm25_top_k(None, index, 5), "bm25_score", "bm25_rank") == usual


def test_long_text_stays_whole(spark):
    rows = [(1, "x " * 5000), (2, "x y"), (3, "y")]
    df = spark.createDataFrame(rows, "bug_id bigint, t string")
    packed = bm25.pack_texts(df, "bug_id", "t", block_tokens=10)
    assert packed.agg(F.sum(F.aggregate("lengths", F.lit(0), lambda a, x: a + x))).first()[0] == 5003


def test_empty_corpus(spark):
    index = bm25.build_index(spark.createDataFrame([], "bug_id bigint, t string"), "bug_id", "t")
    queries = spark.createDataFrame([(1, "x")], "query_id bigint, query_text string")
    assert bm25.bm25_top_k(queries, index, 3).count() == 0


@pytest.mark.parametrize("parts, block_rows", [(1, 1000), (5, 7)])
def test_dense_top_k(spark, route, parts, block_rows):
    data = vectors(50)
    df = spark.createDataFrame(list(data.items()), "bug_id bigint, embedding array<float>").repartition(parts)
    queries = df.withColumnRenamed("bug_id", "query_id")
    got = lists(dense.dense_top_k(queries, df, 8, block_rows=block_rows), "dense_score", "raw_rank")
    for q, v in data.items():
        want = twins.best(twins.dot_scores(data, v), 8, decimals=9, zeros=True)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-9)


def test_self_exclusion(spark):
    data = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [0.8, 0.2]}
    df = spark.createDataFrame(list(data.items()), "bug_id bigint, embedding array<float>")
    queries = df.withColumnRenamed("bug_id", "query_id").filter("query_id = 1")
    after = dense.dense_neighbours(queries, df, 3).orderBy("dense_rank").collect()
    assert [(r.bug_id, r.dense_rank, r.raw_rank) for r in after] == [(2, 1, 2), (4, 2, 3)]
    before = dense.dense_neighbours(queries, df, 3, exclude="before").orderBy("dense_rank").collect()
    assert [r.bug_id for r in before] == [2, 4, 3]
    assert dense.dense_neighbours(queries, df, 0, exclude="none").count() == 1
    assert dense.dense_neighbours(queries, df, 99, exclude="none").count() == 4
    with pytest.raises(ValueError, match="unknown exclusion"):
        dense.dense_neighbours(queries, df, 3, exclude="never")


def test_rrf(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id bigint, bug_id bigint, dense_score double, dense_rank int")
    words = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id bigint, bug_id bigint, bm25_score double, bm25_rank int")
    rows = {r.bug_id: r for r in fuse.rrf(near, words, 5).collect()}
    assert rows[10].hybrid_score == 1 / 61 + 1 / (60 + 1e9)
    assert rows[11].hybrid_score == 1 / 62 + 1 / 61
    assert [rows[i].hybrid_rank for i in (11, 10, 12)] == [1, 2, 3]
    assert fuse.rrf(near, words, 0).count() == 1


def test_dense_as_hybrid(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1)], "query_id bigint, bug_id bigint, dense_score double, dense_rank int")
    row = fuse.dense_as_hybrid(near).first()
    assert (row.hybrid_score, row.bm25_score, row.bm25_rank, row.hybrid_rank) == (0.9, 0.0, None, 1)


def test_token_hash_vectors(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, None), (3, "a a b")], "id bigint, t string")
    rows = {r.id: r.embedding for r in embed.token_hash_vectors(df, "id", "t", dim=8).collect()}
    assert rows[1] == rows[3] and sum(x * x for x in rows[1]) == pytest.approx(1.0)
    assert set(rows[2]) == {0.0}
    asked = {r.id: r.embedding for r in embed.token_hash_vectors(df, "id", "t", dim=8, as_query=True).collect()}
    assert asked[2] != rows[2]


def test_plugin_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, t string")
    make = lambda: lambda batch: [[len(t), 1.0] for t in batch]
    rows = {r.id: r.embedding for r in embed.embed(df, "id", "t", make, batch_size=1).collect()}
    assert rows[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and rows[2] == [0.0, 1.0]


def test_tf_idf_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id bigint, t string")
    corpus, others = embed.tf_idf_vectors(df, "id", "t", dim=64, others=df)
    assert sum(x * x for x in corpus.first().embedding) == pytest.approx(1.0, abs=1e-6)
    assert others.count() == 2
