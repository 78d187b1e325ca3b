"""Pairs that cost less: title words of query texts, blocks with numbers for terms, products in float32."""

from __future__ import annotations

import numpy as np
import pytest

from rankjobs.operators import blocks, bm25, rerank


def test_only_words_of_titles_go_along_with_pairs(spark, monkeypatch):
    staged = {}
    stage = rerank.stage
    monkeypatch.setattr(rerank, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    texts = {1: "Alpha beta gamma alpha", 2: None, 3: "delta epsilon", 4: "zeta"}
    titles = {7: "beta BETA zeta", 8: "", 9: "theta", 10: None}
    queries = spark.createDataFrame([*texts.items(), (3, "theta delta")], "query_id bigint, query_text string")
    pairs = spark.createDataFrame([(q, t, x) for q in (*texts, 5) for t, x in titles.items()], "query_id bigint, testcase_id bigint, testcase_title string")
    got = sorted((r.query_id, r.testcase_id, r.raw_score) for r in rerank.token_overlap_scorer(pairs, queries).collect())

    def overlap(text, title):
        a, b = ({w.lower() for w in (x or "").split()} for x in (text, title))
        return len(a & b) / len(a | b) if a | b else 0.0

    rows = [*texts.items(), (3, "theta delta"), (5, None)]
    assert got == sorted((q, t, overlap(text, x)) for q, text in rows for t, x in titles.items())
    kept = {w for r in staged["query-words"].collect() for w in r["_known"] or ()}
    assert kept == {"beta", "zeta", "theta"}


def test_blocks_that_ask_each_other_have_numbers_and_no_lone_terms(spark):
    rng = np.random.default_rng(4)
    ids = [i % 50 for i in range(60)]  # repeated ids
    texts = [(i, " ".join([f"w{w}" for w in rng.integers(0, 30, 25)] + [f"only{n}"])) for n, i in enumerate(ids)] + [(99, "lonely"), (98, "")]
    frame = spark.createDataFrame(texts, "bug_id bigint, bug_text_enriched string").repartition(3)
    index = bm25.build_index(frame, block_rows=16)
    numbered = bm25._numbered_blocks(index, 2).collect()
    assert sorted(i for r in numbered for i in r["ids"]) == sorted(i for i, _ in texts)
    numbers = [np.frombuffer(r["numbers"], np.int64) for r in numbered]
    assert all((np.diff(n) > 0).all() for n in numbers) and len(set(np.concatenate(numbers).tolist())) == 30
    for fill_zero, exclude_self in ((False, True), (True, True), (False, False)):
        options = {"exclude_self": exclude_self, "fill_zero": fill_zero}
        own = bm25.bm25_top_k(None, index, 7, **options)
        asked = frame.withColumnsRenamed({"bug_id": "query_id", "bug_text_enriched": "query_text"})
        words = bm25.bm25_top_k(asked, index, 7, block_rows=16, **options)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, words.collect()))


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_float32_products_keep_what_exact_sums_keep(sign):
    rng = np.random.default_rng(6)
    rows, columns, terms = 300, 700, 60
    left, right = (np.where(rng.random((n, terms)) < 0.4, rng.random((n, terms)), 0) for n in (rows, columns))
    left[:, :5] *= sign
    right[9::10] = right[8::10] * (1 + 1e-9)  # differ by less than float32 can tell, and less than the last decimal
    right[5::10] = right[4::10]
    right[3::50] = 0
    q_term, q_doc = np.nonzero(left.T)
    c_term, c_doc = np.nonzero(right.T)
    count = np.bincount(c_term, minlength=terms)
    scores = bm25.TermScores(
        np.arange(rows), q_term, q_doc, left[q_doc, q_term], np.arange(columns) + 200,
        np.cumsum(count) - count, count, c_doc, right[c_doc, c_term], True, False,
    )
    assert (scores.near_left.dtype == np.float32) == (sign > 0)
    want = np.round(left @ right.T, 6)
    want[want == 0] = -np.inf
    want[np.arange(rows)[:, None] == np.arange(columns) + 200] = -np.inf
    best, plain = blocks.BestLists(np.arange(rows), 12), blocks.BestLists(np.arange(rows), 12)
    best.meet(np.arange(columns) + 200, scores, 6)
    plain.meet(np.arange(columns) + 200, blocks.Matrix(want), 6)
    assert np.array_equal(best.rows, plain.rows) and np.array_equal(best.ids, plain.ids) and np.allclose(best.values, plain.values, atol=1e-9)
