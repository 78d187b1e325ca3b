"""Lists that are kept over blocks, with scores in float32 first."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from rankjobs.operators import blocks, cells, dense


def brute(scores, ids, k, decimals=9):
    rows = []
    for row in np.round(scores, decimals):
        found = sorted((-s, i) for s, i in zip(row, ids) if np.isfinite(s))[:k]
        rows.append([(i, -s) for s, i in found])
    return rows


def kept(lists):
    return [list(zip(lists.ids[lists.rows == r].tolist(), lists.values[lists.rows == r].tolist())) for r in range(lists.query_ids.size)]


@pytest.mark.parametrize("k", [1, 5, 40])
@pytest.mark.parametrize("copies", [1, 30])
def test_products_keep_what_exact_scores_keep(k, copies):
    rng = np.random.default_rng(k + copies)
    q = rng.normal(size=(600, 16)).astype(np.float32)
    c = np.repeat(rng.normal(size=(300 // copies, 16)), copies, axis=0).astype(np.float32)
    c[7::11] = np.nextafter(c[7::11], np.float32(9))  # differ by less than float32 sums can tell
    q[:50] = c[:50]
    ids = rng.permutation(len(c))
    lists = blocks.BestLists(np.arange(len(q)), k)
    for start in range(0, len(c), 45):
        lists.meet(ids[start : start + 45], blocks.Products(q, c[start : start + 45]), 9)
    want = brute(q.astype(np.float64) @ c.astype(np.float64).T, ids, k)
    for have, wanted in zip(kept(lists), want):
        assert [i for i, _ in have] == [i for i, _ in wanted]
        assert [s for _, s in have] == pytest.approx([s for _, s in wanted], abs=1.5e-9)


def test_hidden_pairs_and_rows_that_were_not_scored():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(12, 4)).astype(np.float32)
    hide = rng.random((9, 12)) < 0.7
    exact = np.where(hide, -np.inf, q.astype(np.float64) @ c.astype(np.float64).T)
    lists = blocks.BestLists(np.arange(9), 3)
    lists.meet(np.arange(12), blocks.Products(q, c, lambda a, b: hide[a:b]), 9)
    assert [[i for i, _ in x] for x in kept(lists)] == [[i for i, _ in x] for x in brute(exact, range(12), 3)]
    some = np.array([1, 4, 8])
    lists = blocks.BestLists(np.arange(9), 3)
    lists.meet(np.arange(12), blocks.Products(q[some], c), 9, some)
    whole = brute(q.astype(np.float64) @ c.astype(np.float64).T, range(12), 3)
    assert [[i for i, _ in x] for x in kept(lists)] == [[i for i, _ in whole[r]] if r in some else [] for r in range(9)]


def test_large_and_infinite_vectors_are_scored_in_float64():
    q, c = np.array([[1e25, 0.0]], np.float32), np.array([[1e25, 1.0], [2e25, 0.0], [-np.inf, 0.0]], np.float32)
    lists = blocks.BestLists(np.array([5]), 2)
    lists.meet(np.arange(3), blocks.Products(q, c), 9)
    assert lists.ids.tolist() == [1, 0]


def test_lists_do_not_hold_the_batches_of_their_queries():
    """A view of the ids held each whole batch, so memory grew with the query blocks."""
    wide = 1 << 20

    def batches():
        for block in range(24):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.int64()),
                    pa.array([[block]], pa.list_(pa.int64())), pa.array([b"x" * wide], pa.binary()),
                ],
                names=["grid_column", "grid_row", "q_block_id", "q_ids", "q_values"],
            )

    def one_buffer(source):
        # as a batch comes to a task: one buffer for all its columns
        for batch in source:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.ipc.open_stream(pa.BufferReader(sink.getvalue())).read_next_batch()

    def score(batch, i):
        ids = blocks.list_values(batch, "q_ids", i, np.int64)
        return ids, np.array([1]), blocks.Matrix(np.ones((1, 1)))

    held: list[int] = []
    run = blocks.score_blocks(SimpleNamespace(mapInArrow=lambda f, schema: f), score, 1)
    assert sum(len(b) for b in run(one_buffer(batches()))) == 24
    assert max(held) - held[0] < 8 * wide


def test_vectors_are_bytes(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>").coalesce(1)
    packed = dense.pack_vectors(frame, "id")
    assert dict(packed.dtypes)["values"] == "binary"
    assert dict(dense.merged_vectors(packed).dtypes)["values"] == "binary"
    assert np.frombuffer(packed.first()["values"], np.float32).tolist() == [1, 0, 0, 1]
    in_cells = cells.pack_cells(frame, "id", np.eye(2), 2)
    assert dict(in_cells.dtypes)["values"] == "binary"
