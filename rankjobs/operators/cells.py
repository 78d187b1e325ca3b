"""Exact cosine top-k that skips what cannot be near: coarse cells, radii and the triangle inequality.

Both sides are dealt to coarse cells around centres and packed into blocks of one cell.
A block has a centre direction and the largest angle of its vectors to it. The angle of a
query to any vector of the block is at least its angle to the centre less that radius, so
a query whose k-th best score so far is better than the cosine of that bound skips the
block. To have such a score from the start, every query first meets one block of its own
cell. The result is that of ``dense.dense_top_k``; only the work differs, by how clustered
the vectors are.

Centres are fit on a bounded sample (``SAMPLE_ROWS``, by a hash of the ids); all rows are
dealt. A cell with a third of all rows is spread over partitions by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.functions.numeric import top_k
from rankjobs.operators import blocks
from rankjobs.sources.artifacts import check_vectors, stage

SAMPLE_ROWS = 16_384
MOST_CELLS = 1024
BLOCK_ROWS = 512
# Cosines and angles of float vectors are off by less than this.
MARGIN = 1e-6

BLOCK = "block_id bigint, cell int, ids array<bigint>, values binary, centre array<double>, radius double"
FLOORS = "block_id bigint, floors array<double>"


def fit_centres(vectors: DataFrame, id_column: str, n_cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means on a bounded sample; fewer where the sample has fewer different rows."""
    sample = vectors.orderBy(F.xxhash64(id_column), id_column).limit(sample_rows).select("embedding").collect()
    rows = np.array([r["embedding"] for r in sample], dtype=np.float64)
    different = np.unique(rows, axis=0)
    centres = different[np.random.default_rng(3).permutation(len(different))[:n_cells]]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def pack_cells(vectors: DataFrame, id_column: str, centres: np.ndarray, rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``block_rows`` vectors of one cell, with centre and radius."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(batch), -1)
                cell = np.argmax(x @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "embedding", "cell"])

    def block(cell: int, ids: np.ndarray, x: np.ndarray, number: int) -> pa.RecordBatch:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        centre = unit.sum(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-9 else centres[cell]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        id_list, middle = (pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (ids, centre))
        block_id = (TaskContext.get().partitionId() << 32) + number
        values = pa.array([x.astype(np.float32).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([block_id], pa.int64()), pa.array([cell], pa.int32()), id_list, values, middle, pa.array([radius])],
            names=["block_id", "cell", "ids", "values", "centre", "radius"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, parts, held, number = None, [], [], 0, 0
        for batch in batches:
            cells = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(batch)]
            for start, end in zip(edges, edges[1:]):
                while start < end:
                    if held and (cells[start] != cell or held == block_rows):
                        yield block(cell, np.concatenate(ids), np.concatenate(parts), number)
                        ids, parts, held, number = [], [], 0, number + 1
                    cell = int(cells[start])
                    part = batch.slice(start, min(end - start, block_rows - held))
                    ids.append(part.column(0).to_numpy())
                    flat = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                    parts.append(flat.reshape(len(part), -1))
                    held, start = held + len(part), start + len(part)
        if held:
            yield block(cell, np.concatenate(ids), np.concatenate(parts), number)

    dealt = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col("embedding").cast("array<float>")).mapInArrow(
        assign, "id bigint, embedding array<float>, cell int"
    )
    # ranges of (cell, hash of the id): neighbours stay together, and a hot cell falls into several ranges
    ranges = max(1, math.ceil(rows / (16 * block_rows)))
    order = ["cell", F.xxhash64("id")]
    return dealt.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK)


def bounds(q: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """The largest cosine that each query can have with a vector of a block."""
    apart = np.arccos(np.clip(q @ centre, -1, 1)) - radius
    return np.cos(np.maximum(apart, 0.0)) + MARGIN


def _row(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = blocks.list_values(batch, f"{prefix}ids", i, np.int64)
    return ids, blocks.packed_values(batch, f"{prefix}values", i, np.float32, np.float32).reshape(ids.size, -1)


def _floors(k: int):
    """The k-th best score of every query of a block in one corpus block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, floors = [], []
            for i in range(len(batch)):
                (_, q), (_, c) = _row(batch, i, "q_"), _row(batch, i, "c_")
                scores = np.round(q.astype(np.float64) @ c.astype(np.float64).T, blocks.SCORE_DECIMALS)
                best = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
                ids.append(batch.column("q_block_id")[i].as_py())
                floors.append(best.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(floors, pa.list_(pa.float64()))], names=["block_id", "floors"])

    return run


def _search(k: int, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, blocks.BestLists] = {}
        cell, met, done = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            while best:
                yield best.popitem()[1].batch()

        for batch in batches:
            cells = zip(batch.column("grid_column").to_pylist(), batch.column("grid_row").to_pylist())
            numbers, radii = batch.column("q_block_id").to_pylist(), batch.column("c_radius").to_pylist()
            for i, here in enumerate(cells):
                if here != cell:
                    if not report:
                        yield from flush()
                    best.clear()
                    cell = here
                ids, q = _row(batch, i, "q_")
                if numbers[i] not in best:
                    state = best[numbers[i]] = blocks.BestLists(ids, k)
                    known = batch.column("q_floors")[i].values
                    if known is not None:
                        # the rows behind them come again, so an equal score counts whatever its id
                        state.floors[:] = known.to_numpy(zero_copy_only=False)
                state = best[numbers[i]]
                may = np.flatnonzero(bounds(q, blocks.list_values(batch, "c_centre", i, np.float64), radii[i]) >= state.floors)
                met, done = met + ids.size, done + may.size
                if may.size:
                    items, c = _row(batch, i, "c_")
                    state.meet(items, blocks.Products(q if may.size == ids.size else q[may], c), blocks.SCORE_DECIMALS, may)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64()), pa.array([done], pa.int64())], names=["met", "done"])
        else:
            yield from flush()

    return run


def _met(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, item_id: str, block_rows: int) -> DataFrame | None:
    sides = [(queries, query_id), (corpus, item_id)]
    lengths = {check_vectors(df) for df, _ in sides} - {0}
    if len(lengths) > 1:
        raise ValueError(f"queries and corpus have vectors of different lengths: {sorted(lengths)}")
    n = [df.count() for df, _ in sides]
    if not all(n):
        return None
    centres = fit_centres(corpus, item_id, min(MOST_CELLS, max(1, round(math.sqrt(n[1])))))
    left, right = (stage(pack_cells(df, name, centres, rows, block_rows), "cells") for (df, name), rows in zip(sides, n))
    # one block of each cell, the largest, gives its queries a first k-th best score
    first = right.groupBy("cell").agg(F.max_by("block_id", F.struct(F.size("ids"), "block_id")).alias("block_id"))
    seeds = right.join(first, ["cell", "block_id"], "left_semi").select("cell", F.col("ids").alias("c_ids"), F.col("values").alias("c_values"))
    asked = left.select("cell", F.col("block_id").alias("q_block_id"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    floors = stage(asked.join(seeds, "cell").drop("cell").mapInArrow(_floors(k), FLOORS), "floors")
    left = left.join(floors, "block_id", "left").select("block_id", "ids", "values", "floors")
    right = right.select("block_id", "ids", "values", "centre", "radius")
    query_bytes = n[0] * (16 + 4 * max(lengths))
    return blocks.meet(left, right, max(1, left.count()), max(1, right.count()), query_bytes, blocks_per_group=64, blocks_per_shard=256)


def cell_top_k(
    queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", item_id: str = "bug_id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k nearest corpus rows of every query row: ``query_id, bug_id, dense_score, raw_rank``, as ``dense.dense_top_k``."""
    k = top_k(k)
    pairs = _met(queries, corpus, k, query_id, item_id, block_rows)
    if pairs is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, bug_id bigint, dense_score double, raw_rank int")
    found = pairs.mapInArrow(_search(k, False), blocks.RESULT)
    return blocks.merge_top_k(found, k, "raw_rank").select(
        "query_id", F.col("item_id").alias("bug_id"), F.col("score").alias("dense_score"), "raw_rank"
    )


def skipped_share(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", item_id: str = "bug_id", block_rows: int = BLOCK_ROWS) -> float:
    """The share of (query, block) pairs whose scores are not computed."""
    pairs = _met(queries, corpus, top_k(k), query_id, item_id, block_rows)
    if pairs is None:
        return 0.0
    row = pairs.mapInArrow(_search(k, True), "met bigint, done bigint").agg(F.sum("met").alias("met"), F.sum("done").alias("done")).first()
    return 1 - row["done"] / row["met"] if row["met"] else 0.0
