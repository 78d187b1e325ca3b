"""Exact cosine top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.functions.numeric import top_k
from rankjobs.operators import blocks
from rankjobs.sources.artifacts import stage


# Vectors are 32-bit floats as bytes: readers of lists hold three numbers for each element, and writers copy them one by one.
VECTOR_BLOCK = "block_id bigint, ids array<bigint>, values binary"


def pack_vectors(vectors: DataFrame, id_column: str, block_rows: int = 2048) -> DataFrame:
    """Blocks of at most ``block_rows`` vectors, made where the rows are read: no shuffle.

    A vector that is NULL, has a NULL element or another length than the one before it
    is an error that names its id.
    """

    def whole(part: pa.RecordBatch, length: int | None) -> int:
        column = part.column(1)
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        length = int(lengths[0]) if length is None else length
        bad = (lengths != length) | (lengths < 0)
        if column.flatten().null_count:
            bad |= np.array([v is not None and None in v for v in column.to_pylist()])
        if bad.any():
            at = int(np.flatnonzero(bad)[0])
            raise ValueError(f"vector of {id_column} {part.column(0)[at].as_py()} is incomplete or not of length {length}")
        return length

    def emit(ids: list[np.ndarray], flat: list[np.ndarray], number: int) -> pa.RecordBatch:
        id_array, values = np.concatenate(ids), np.concatenate(flat)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, id_array.size], pa.int32()), pa.array(id_array)),
                pa.array([values.tobytes()], pa.binary()),
            ],
            names=["block_id", "ids", "values"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        held = number = 0
        length = None
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                part = batch.slice(start, block_rows)
                length = whole(part, length)
                if held and held + len(part) > block_rows:
                    yield emit(ids, flat, number)
                    ids, flat, held, number = [], [], 0, number + 1
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                flat.append(np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32))
                held += len(part)
        if held:
            yield emit(ids, flat, number)

    return vectors.select(F.col(id_column).cast("bigint"), F.col("embedding").cast("array<float>")).mapInArrow(run, VECTOR_BLOCK)


@dataclass(frozen=True)
class PackedVectors:
    """A stored corpus in blocks, counted, for searches that come again."""

    blocks: DataFrame
    n_blocks: int


def packed_corpus(vectors: DataFrame, item_id: str = "bug_id", block_rows: int = 2048) -> PackedVectors:
    blocks_table = stage(pack_vectors(vectors, item_id, block_rows), "vector-blocks")
    return PackedVectors(blocks_table, blocks_table.count())


def merged_vectors(packed: DataFrame, block_rows: int = 2048) -> DataFrame:
    """The rows of blocks in fuller blocks of at most ``block_rows`` vectors, where no larger one comes in; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        rows = number = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.array(np.concatenate(ids), pa.int64())),
                    pa.array([np.concatenate(values).tobytes()], pa.binary()),
                ],
                names=["block_id", "ids", "values"],
            )

        for batch in batches:
            for i in range(len(batch)):
                part = blocks.list_values(batch, "ids", i, np.int64)
                if rows and rows + part.size > block_rows:
                    yield emit()
                    ids, values, rows, number = [], [], 0, number + 1
                ids.append(part)
                values.append(blocks.packed_values(batch, "values", i, np.float32, np.float32))
                rows += part.size
        if rows:
            yield emit()

    return packed.select("block_id", "ids", "values").mapInArrow(run, VECTOR_BLOCK)


def dense_top_k(
    queries: DataFrame,
    corpus: DataFrame | PackedVectors,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "bug_id",
    block_rows: int = 2048,
) -> DataFrame:
    """The k nearest corpus rows of every query row by cosine, exactly.

    Both sides are ``(id, embedding)`` with unit vectors; the corpus may be packed
    already. Returns ``query_id, bug_id, dense_score, raw_rank``; a corpus smaller than
    k gives what it has. Ties go to the smaller id.
    """

    def score(batch: pa.RecordBatch, i: int):
        query_ids = blocks.list_values(batch, "q_ids", i, np.int64)
        item_ids = blocks.list_values(batch, "c_ids", i, np.int64)
        q = blocks.packed_values(batch, "q_values", i, np.float32, np.float32).reshape(query_ids.size, -1)
        c = blocks.packed_values(batch, "c_values", i, np.float32, np.float32).reshape(item_ids.size, -1)
        return query_ids, item_ids, blocks.Products(q, c)

    k = top_k(k)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if isinstance(corpus, PackedVectors):
        items, item_blocks = corpus.blocks, corpus.n_blocks
    else:
        items, item_blocks = pack_vectors(corpus, item_id, block_rows), math.ceil(corpus.count() / block_rows)
    asked, asked_blocks = pack_vectors(queries, query_id, block_rows), math.ceil(size.n / block_rows)
    query_bytes = size.n * (8 + 4 * (size.dim or 0))
    if blocks.rounds_of(query_bytes, size.n, k) > 1:
        # read once per round
        asked = stage(asked, "query-blocks")
        asked_blocks = asked.count()
        if not isinstance(corpus, PackedVectors):
            items = stage(items, "vector-blocks")
    found = blocks.search(
        asked, items, asked_blocks, max(1, item_blocks), query_bytes, size.n,
        lambda pairs: blocks.score_blocks(pairs, score, k), k, "raw_rank",
    )
    return found.select(
        "query_id", F.col("item_id").alias("bug_id"), F.col("score").alias("dense_score"), "raw_rank"
    )


def without_self(found: DataFrame, k: int) -> DataFrame:
    """Drop a query's own row from its k nearest, so that k - 1 are left when it was there.

    ``dense_rank`` counts the rows that stay.
    """
    others = found.filter((F.col("raw_rank") <= k) & (F.col("bug_id") != F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy("raw_rank")
    return others.withColumn("dense_rank", F.row_number().over(order))


def dense_neighbours(
    queries: DataFrame, corpus: DataFrame | PackedVectors, k: int, *, exclude: str = "after", query_id: str = "query_id", block_rows: int = 2048
) -> DataFrame:
    """Nearest rows other than the query itself.

    ``exclude='after'`` searches k and then drops the query's own row; ``'before'``
    always returns k others where there are that many; ``'none'`` keeps it.
    """
    k = top_k(k)
    if exclude == "none":
        return dense_top_k(queries, corpus, k, query_id=query_id, block_rows=block_rows).withColumn("dense_rank", F.col("raw_rank"))
    if exclude not in ("after", "before"):
        raise ValueError(f"unknown exclusion: {exclude!r}")
    depth = k if exclude == "after" else k + 1
    found = without_self(dense_top_k(queries, corpus, depth, query_id=query_id, block_rows=block_rows), depth)
    return found.filter(F.col("dense_rank") <= k)


def dense_top_k_before(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "bug_id",
    block_rows: int = 2048,
) -> DataFrame:
    """The k nearest corpus rows that are strictly earlier than the query: ``query_id, bug_id, dense_score, raw_rank``.

    Both sides are ``(id, embedding, moment)`` with a bigint moment; a NULL moment is
    before all others, so such rows are history for all dated queries and have none.
    Both sides are sorted into blocks by time, once and while narrow. A corpus block that
    begins at or after the latest query of a query block is never read with it, so about half of the
    work of a search over all rows goes; rows inside a border block are masked.
    """

    def moments(rows: DataFrame, id_column: str) -> DataFrame:
        moment = F.coalesce(F.col("moment"), F.lit(-(1 << 63)).cast("bigint"))
        return rows.select(F.col(id_column).cast("bigint").alias("id"), F.col("embedding").cast("array<float>"), moment.alias("moment"))

    def packed(rows: DataFrame, n: int) -> DataFrame:
        # equal moments are dealt by id, so that a hot one is spread over ranges
        # and a range holds two blocks only: late ranges are met by few queries, so tasks should get some of each
        ranges = max(1, math.ceil(n / (2 * block_rows)))
        order = ["moment", F.xxhash64("id")]
        ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        return stage(_pack_timed(ranged, block_rows), "timed-blocks")

    def score(batch: pa.RecordBatch, i: int):
        query_ids = blocks.list_values(batch, "q_ids", i, np.int64)
        item_ids = blocks.list_values(batch, "c_ids", i, np.int64)
        q = blocks.packed_values(batch, "q_values", i, np.float32, np.float32).reshape(query_ids.size, -1)
        c = blocks.packed_values(batch, "c_values", i, np.float32, np.float32).reshape(item_ids.size, -1)
        when, then = blocks.list_values(batch, "q_moments", i, np.int64), blocks.list_values(batch, "c_moments", i, np.int64)
        if then.max() < when.min():  # only border blocks have rows to mask
            return query_ids, item_ids, blocks.Products(q, c)
        return query_ids, item_ids, blocks.Products(q, c, lambda start, stop: then[None, :] >= when[start:stop, None])

    k = top_k(k)
    left, right = moments(queries, query_id), moments(corpus, item_id)
    counts = [x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first() for x in (left, right)]
    left, right = (packed(x, c.n) for x, c in zip((left, right), counts))
    found = blocks.search(
        left,
        right,
        max(1, left.count()),
        max(1, right.count()),
        counts[0].n * (16 + 4 * (counts[0].dim or 0)),
        counts[0].n,
        lambda pairs: blocks.score_blocks(pairs.filter("c_low < q_high"), score, k),
        k,
        "raw_rank",
    )
    return found.select(
        "query_id", F.col("item_id").alias("bug_id"), F.col("score").alias("dense_score"), "raw_rank"
    )


def _pack_timed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of ``(id, embedding, moment)`` in the given order, with their earliest and latest moment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                part = batch.slice(start, block_rows)
                lengths = pc.fill_null(pc.list_value_length(part.column(1)), -1).to_numpy(zero_copy_only=False)
                values = part.column(1).flatten()
                if values.null_count or (lengths != lengths[0]).any() or lengths[0] < 0:
                    raise ValueError(f"a vector near id {part.column(0)[0].as_py()} is incomplete or of another length")
                moments = part.column(2).to_numpy()
                ids, when = (
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (part.column(0).to_numpy(), moments)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                        pa.array([moments.min()], pa.int64()),
                        pa.array([moments.max()], pa.int64()),
                        ids,
                        pa.array([values.to_numpy().tobytes()], pa.binary()),
                        when,
                    ],
                    names=["block_id", "low", "high", "ids", "values", "moments"],
                )
                number += 1

    return rows.mapInArrow(run, "block_id bigint, low bigint, high bigint, ids array<bigint>, values binary, moments array<bigint>")
