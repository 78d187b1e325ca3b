"""Search by cells against all scores, on clustered, random and repeated vectors."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from rankjobs.operators import cells


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def drawn(kind, n=600, dim=12):
    r = np.random.default_rng(7)
    if kind == "random":
        x = r.standard_normal((n, dim))
    else:
        x = np.repeat(r.standard_normal((12, dim)) * 6, n // 12, axis=0) + 0.3 * r.standard_normal((n, dim))
    if kind == "repeated":
        # a third of all rows are one vector
        x[: n // 3] = x[0]
    return unit(x).astype(np.float32)


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, embedding array<float>").repartition(3)


def lists(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["raw_rank"], r["bug_id"], r["dense_score"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("kind", ["clustered", "random", "repeated"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_to_all_scores(spark, kind, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(cells.blocks, "BROADCAST_BYTES", -1)
    x = drawn(kind)
    got = lists(cells.cell_top_k(frame(spark, x[::5], "query_id"), frame(spark, x, "bug_id"), 4, block_rows=32))
    wide = x.astype(np.float64)
    assert len(got) == len(x[::5])
    for i, q in enumerate(wide[::5]):
        scores = np.round(wide @ q, 9)
        want = sorted(range(len(x)), key=lambda j: (-scores[j], j))[:4]
        # a last digit may differ by the order of additions
        assert [s for _, _, s in got[i]] == pytest.approx([scores[j] for j in want], abs=2e-9)
        assert all(abs(scores[j] - s) < 2e-9 for _, j, s in got[i])
        if kind == "repeated" and i < len(x) // 15:
            assert [j for _, j, _ in got[i]] == [0, 1, 2, 3]


def test_clustered_vectors_skip_most(spark):
    x = drawn("clustered")
    assert cells.skipped_share(frame(spark, x, "query_id"), frame(spark, x, "bug_id"), 4, block_rows=32) > 0.6


def test_bounds_hold_for_all_members():
    r = np.random.default_rng(1)
    for spread in (0.01, 0.5, 3.0):
        members = unit(r.standard_normal(6) * 2 + spread * r.standard_normal((40, 6)))
        centre = members.sum(axis=0) / np.linalg.norm(members.sum(axis=0))
        radius = float(np.arccos(np.clip(members @ centre, -1, 1)).max())
        q = unit(r.standard_normal((200, 6)))
        assert (cells.bounds(q, centre, radius) >= (q @ members.T).max(axis=1)).all()


def test_small_and_empty_tables(spark):
    x = drawn("random", 12)[:3]
    got = lists(cells.cell_top_k(frame(spark, x, "query_id"), frame(spark, x, "bug_id"), 10))
    assert all(len(v) == 3 for v in got.values()) and len(got) == 3
    empty = frame(spark, x, "bug_id").limit(0)
    assert cells.cell_top_k(frame(spark, x, "query_id"), empty, 2).count() == 0
    assert cells.cell_top_k(empty.withColumnRenamed("bug_id", "query_id"), frame(spark, x, "bug_id"), 2).count() == 0
    with pytest.raises(ValueError, match="length"):
        cells.cell_top_k(frame(spark, x[:, :5], "query_id"), frame(spark, x, "bug_id"), 2)
