"""Evaluation with earlier history only, and test cases that share bugs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankjobs.operators import cooccur, dense


def drawn(n, seed=1, dim=8):
    r = np.random.default_rng(seed)
    vectors = r.standard_normal((n, dim))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # a third of all rows share one moment, some have none
    moments = [None if i % 17 == 0 else 50 if i % 3 == 0 else int(r.integers(0, 100)) for i in range(n)]
    return [(i, v.astype(np.float32).tolist(), m) for i, (v, m) in enumerate(zip(vectors, moments))]


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_earlier_rows_are_found(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(dense.blocks, "BROADCAST_BYTES", -1)
    rows = drawn(300)
    rows[5] = (5, rows[8][1], rows[5][2])
    frame = spark.createDataFrame(rows, "bug_id bigint, embedding array<float>, moment bigint").repartition(3)
    got = defaultdict(list)
    for r in dense.dense_top_k_before(frame.withColumnRenamed("bug_id", "query_id"), frame, 4, block_rows=16).collect():
        got[r["query_id"]].append((r["raw_rank"], r["bug_id"], r["dense_score"]))
    time = lambda m: -1 if m is None else m
    for i, v, m in rows:
        scores = [(-round(float(np.dot(np.float64(v), np.float64(w))), 9), j) for j, w, t in rows if time(t) < time(m)]
        want = [(place, j, -s) for place, (s, j) in enumerate(sorted(scores)[:4], 1)]
        have = sorted(got[i])
        assert [x[:2] for x in have] == [x[:2] for x in want]
        assert [x[2] for x in have] == pytest.approx([x[2] for x in want], abs=2e-9)


def test_later_blocks_are_not_read(spark):
    rows = [(i, [1.0, 0.0], i) for i in range(640)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<float>, moment bigint")
    packed = dense._pack_timed(frame.coalesce(1), 32).collect()
    assert len(packed) == 20
    read = sum(c["low"] < q["high"] for q in packed for c in packed)
    assert read == 20 * 21 / 2


def test_incomplete_vectors_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1.0, None], 1), (2, [1.0, 0.0], 2)], "bug_id bigint, embedding array<float>, moment bigint")
    with pytest.raises(Exception, match="incomplete"):
        dense.dense_top_k_before(frame.withColumnRenamed("bug_id", "query_id"), frame, 1).collect()


def shared(links, k):
    of = defaultdict(set)
    for b, t in links:
        if b is not None and t is not None:
            of[b].add(t)
    counts = defaultdict(Counter)
    for cases in of.values():
        for a in cases:
            for b in cases:
                if a != b:
                    counts[a][b] += 1
    out = []
    for a, others in counts.items():
        best = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(a, b, n, place) for place, (b, n) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"block_cases": 16, "cell_links": 20}])
def test_shared_bugs_with_a_hot_bug_and_a_hot_case(spark, settings, monkeypatch):
    monkeypatch.setattr(cooccur, "AT_ONCE", 50)
    r = random.Random(2)
    links = [(0, t) for t in range(150)] + [(b, 7) for b in range(150)]
    links += [(r.randrange(60), r.randrange(160)) for _ in range(300)] + [(None, 3), (4, None)]
    links += links[:40]
    frame = spark.createDataFrame(links, "bug_id bigint, testcase_id bigint").repartition(4)
    found = cooccur.co_occurrence(frame, 5, **settings)
    assert sorted(tuple(x) for x in found.collect()) == shared(links, 5)


def test_no_shared_bugs(spark):
    lonely = spark.createDataFrame([(1, 1), (2, 2)], "bug_id bigint, testcase_id bigint")
    assert cooccur.co_occurrence(lonely).count() == 0
    assert cooccur.co_occurrence(lonely.limit(0)).count() == 0
