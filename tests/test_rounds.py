"""Search in rounds, and postings as bytes."""

from __future__ import annotations

import tracemalloc

import numpy as np

from rankjobs.operators import blocks, bm25, dense


def test_rounds_copy_no_block_and_keep_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = [i % 37 for i in range(60)]  # repeated ids
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rng.normal(size=(60, 8)))], "id bigint, embedding array<float>")
    queries, corpus = frame.withColumnRenamed("id", "query_id").repartition(3), frame.withColumnRenamed("id", "bug_id").repartition(2)
    want = sorted(map(tuple, dense.dense_top_k(queries, corpus, 4, block_rows=5).collect()))
    sizes = []
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda q, c, n, *a, **b: sizes.append((n, q.count())) or meet(q, c, n, *a, **b))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 400)
    assert sorted(map(tuple, dense.dense_top_k(queries, corpus, 4, block_rows=5).collect())) == want
    # each round has its own few blocks, all rounds together each block once
    assert len(sizes) > 2 and all(n == found for n, found in sizes)
    monkeypatch.undo()
    texts = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} common") for i in ids], "query_id bigint, query_text string")
    index = bm25.build_index(texts, "query_id", "query_text", block_rows=8)
    once = sorted(map(tuple, bm25.bm25_top_k(texts, index, 3, block_rows=8).collect()))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 400)
    assert sorted(map(tuple, bm25.bm25_top_k(texts, index, 3, block_rows=8).collect())) == once


def test_postings_are_bytes(spark):
    packed = bm25.pack_texts(spark.createDataFrame([(1, "a b a"), (2, "b")], "id bigint, text string").coalesce(1), "id", "text")
    assert {dict(packed.dtypes)[c] for c in bm25.POSTINGS} == {"binary"}
    row = packed.first()
    at = [np.frombuffer(row[c], np.int32).tolist() for c in bm25.POSTINGS]
    assert [(row.terms[t], row.ids[d], n) for t, d, n in zip(*at)] == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]


def test_lists_of_many_short_queries_count_for_rounds(spark, monkeypatch):
    # 40 texts of one word are small, but each of them has a list of k rows in a task
    texts = spark.createDataFrame([(i, f"w{i % 5}") for i in range(40)], "query_id bigint, query_text string").coalesce(1)
    index = bm25.build_index(texts, "query_id", "query_text", block_rows=8)
    once = sorted(map(tuple, bm25.bm25_top_k(texts, index, 20, block_rows=8).collect()))
    _, query_bytes, rows = bm25.packed_size(bm25.pack_texts(texts, "query_id", "query_text", 8))
    assert rows == 40
    asked = []
    meet = blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda q, c, n, *a, **b: asked.append(n) or meet(q, c, n, *a, **b))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", query_bytes + 1)
    assert sorted(map(tuple, bm25.bm25_top_k(texts, index, 20, block_rows=8).collect())) == once
    assert len(asked) > 2


def test_term_scores_need_the_memory_of_few_rows(monkeypatch):
    rng = np.random.default_rng(5)
    rows, columns, terms = 600, 3000, 40
    left, right = (np.where(rng.random((n, terms)) < 0.3, rng.integers(1, 9, (n, terms)), 0).astype(float) for n in (rows, columns))
    q_term, q_doc = np.nonzero(left.T)
    c_term, c_doc = np.nonzero(right.T)
    count = np.bincount(c_term, minlength=terms)
    for dense_terms in (bm25.MAX_DENSE_TERMS, 7, 0):
        monkeypatch.setattr(bm25, "MAX_DENSE_TERMS", dense_terms)
        tracemalloc.start()
        scores = bm25.TermScores(
            np.arange(rows), q_term, q_doc, left[q_doc, q_term], np.arange(columns) + 300,
            np.cumsum(count) - count, count, c_doc, right[c_doc, c_term], True, False,
        )
        best = blocks.BestLists(np.arange(rows), 4)
        best.meet(np.arange(columns) + 300, scores, 6)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = left @ right.T
        want[want == 0] = -np.inf
        want[np.arange(rows)[:, None] == np.arange(columns) + 300] = -np.inf
        found = blocks.BestLists(np.arange(rows), 4)
        found.meet(np.arange(columns) + 300, blocks.Matrix(want), 6)
        assert np.array_equal(best.rows, found.rows) and np.array_equal(best.ids, found.ids) and np.array_equal(best.values, found.values)
        # the whole matrix in doubles, twice, as when products and sums are made for all rows at once
        assert peak < 2.6 * 8 * rows * columns, peak
