"""Queries against a corpus, in blocks.

Exact ranking needs the score of every (query, item) pair, and the pairs must not
become rows. So both sides are packed into blocks of bounded size, blocks meet, and
each task keeps only its best k per query. How they meet depends on the checked size
of the query side, which is that of its blocks and of the lists that a task keeps for them:

- Up to ``BROADCAST_BYTES`` the query blocks are broadcast. The corpus is read once
  where it lies and is not shuffled at all.
- Beyond that, the query blocks are asked in rounds of at most that size, one after the
  other. Each round writes its lists, so that neither a copy of a block nor the
  memory of an earlier round is left when the next one begins.

No key of the data is a partitioning key, so a hot term, tag or copy group cannot make
a hot task. What leaves a task is at most k rows per query and grid cell.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESULT = "query_id bigint, item_id bigint, score double"
RESULT_ARROW = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

# The largest query side that is sent to every executor, with its lists in one task.
BROADCAST_BYTES = 128 << 20
# A row number, an id and a score; each query has the same once more.
LIST_ROW_BYTES = 24

# Rows of a score matrix that are computed and cut at once, and pairs that are multiplied one by one.
ROWS_AT_ONCE = 256
PAIRS_AT_ONCE = 4096

# More grid cells than this share partitions.
MAX_PARTITIONS = 20_000

# Scores are compared at this many decimals, so that equal rows tie whatever the
# order was in which their terms were added up; ties go to the smaller id.
SCORE_DECIMALS = 9
# Weighted sums of such scores get more, so that rounding never meets an exact half.
SUM_DECIMALS = 12


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``scores`` the k best columns by (score desc, id asc).

    ``-inf`` marks a column that is no candidate. Returns row numbers, ids, scores.
    """
    k = min(k, scores.shape[1])
    if k == 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0)
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    rows, cols = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
    return cut_rows(rows, ids[cols], scores[rows, cols], k)


def cut_rows(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int):
    """Keep the k best of every row number."""
    # small numbers are sorted by digits, so this costs about one sort of the values
    narrow = np.min_scalar_type(int(rows.max(initial=0)))
    order = np.argsort(-values)
    order = order[np.argsort(rows[order].astype(narrow), kind="stable")]
    tied = (rows[order[1:]] == rows[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    if tied.any():
        at = np.flatnonzero(np.r_[False, tied] | np.r_[tied, False])
        group = np.cumsum(np.r_[True, ~tied])[at]
        order[at] = order[at][np.lexsort((ids[order[at]], group))]
    rows, ids, values = rows[order], ids[order], values[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if rows.size else np.empty(0, dtype=np.int64)
    place = np.arange(rows.size) - np.repeat(starts, np.diff(np.r_[starts, rows.size]))
    keep = place < k
    return rows[keep], ids[keep], values[keep]


def meet(
    queries: DataFrame,
    corpus: DataFrame,
    query_blocks: int,
    corpus_blocks: int,
    query_bytes: int,
    *,
    blocks_per_group: int = 16,
    blocks_per_shard: int = 64,
) -> DataFrame:
    """Every query block next to every corpus block, spread over tasks.

    Both inputs hold one row per block with a ``block_id``. The counts size the grid,
    and ``query_bytes`` is the size of the query side. Columns come back with the
    prefixes ``q_`` and ``c_``. ``search`` keeps larger query sides out of the grid below.
    """

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))

    def in_group(df: DataFrame, column: str, by: str, n: int) -> DataFrame:
        return df.withColumn(column, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))

    def in_all(df: DataFrame, column: str, n: int) -> DataFrame:
        return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    left, right = named(queries, "q_"), named(corpus, "c_")
    parallelism = queries.sparkSession.sparkContext.defaultParallelism
    if query_bytes <= BROADCAST_BYTES:
        # few long tasks, since each brings its best k rows per query to the final merge, but
        # none of more than ``blocks_per_shard`` blocks, so that tasks grow in number and not in size
        groups = max(1, min(query_blocks, blocks_per_group))
        tasks = max(2 * parallelism, math.ceil(corpus_blocks / blocks_per_shard))
        if right.rdd.getNumPartitions() < tasks:
            # a table of a few files: as many tasks as cores, so that none waits for the others
            right = right.repartition(min(parallelism, max(1, corpus_blocks)))
        met = in_all(right.coalesce(tasks), "grid_row", groups).join(
            F.broadcast(in_group(left, "grid_row", "q_block_id", groups)), "grid_row"
        )
        # a task keeps one list per query over all that it reads
        return met.withColumns({"grid_column": F.lit(0), "grid_row": F.lit(0)})

    # Cells to even out over the cores, near square in bytes, since each side is copied
    # along the other one. The query side of a cell is buffered, so it has a limit; the
    # corpus side streams through.
    cells = 8 * parallelism
    groups = round(math.sqrt(cells * query_blocks / corpus_blocks))
    groups = min(max(groups, math.ceil(query_blocks / blocks_per_group), 1), max(1, query_blocks))
    shards = max(math.ceil(cells / groups), math.ceil(corpus_blocks / blocks_per_shard))
    shards = max(1, min(shards, corpus_blocks))
    left = in_all(in_group(left, "grid_row", "q_block_id", groups), "grid_column", shards)
    right = in_all(in_group(right, "grid_column", "c_block_id", shards), "grid_row", groups)
    # the number of partitions is given: the work per byte is high, and adaptive
    # coalescing by bytes would put all of it into one task
    partitions = min(shards * groups, max(cells, MAX_PARTITIONS))
    keys = ["grid_column", "grid_row"]
    return right.repartition(partitions, *keys).join(left.repartition(partitions, *keys).hint("merge"), keys)


def rounds_of(query_bytes: int, query_rows: int, k: int) -> int:
    """How many rounds of at most ``BROADCAST_BYTES`` of queries and their lists a search takes.

    Many short queries are small, but each has a list of k rows in every task.
    """
    return math.ceil((query_bytes + LIST_ROW_BYTES * query_rows * (k + 1)) / max(1, BROADCAST_BYTES))


def search(
    queries: DataFrame,
    corpus: DataFrame,
    query_blocks: int,
    corpus_blocks: int,
    query_bytes: int,
    query_rows: int,
    best: Callable[[DataFrame], DataFrame],
    k: int,
    rank: str,
) -> DataFrame:
    """The final k per query, where ``best`` turns met blocks into the ``RESULT`` rows that tasks keep.

    Blocks of a query side of more than one round (``rounds_of``) should be stored, since their ids deal
    them out to rounds. A query id may come in several blocks, so the rounds are merged in the end.
    """
    # not a name of this module, which goes to the tasks by value
    from rankjobs.sources.artifacts import stage

    rounds = min(rounds_of(query_bytes, query_rows, k), query_blocks)
    if rounds <= 1:
        return merge_top_k(best(meet(queries, corpus, query_blocks, corpus_blocks, min(query_bytes, BROADCAST_BYTES))), k, rank)
    ids = sorted({r.block_id for r in queries.select("block_id").collect()})
    found = []
    for number in range(rounds):
        part = ids[number::rounds]
        asked = queries.filter(F.col("block_id").isin(part))
        met = meet(asked, corpus, len(part), corpus_blocks, min(query_bytes // rounds, BROADCAST_BYTES))
        found.append(stage(merge_top_k(best(met), k, rank).drop(rank), "round"))
    return merge_top_k(functools.reduce(DataFrame.unionAll, found), k, rank)


class Matrix:
    """Scores that are there already, every one exact."""

    slack = share = 0.0

    def __init__(self, values: np.ndarray):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def near(self, start: int, stop: int) -> np.ndarray:
        return self.values[start:stop]

    def exact(self, start: int, stop: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.values[start:stop][rows, columns]


class Products:
    """Scores ``left @ right.T`` of float32 rows, computed where they are wanted.

    ``near`` multiplies in float32 and is off by at most ``slack``, the bound of a sum in any
    order; ``exact`` multiplies the few pairs that it is asked for in float64. Without a
    finite bound all is done in float64. ``hidden(start, stop)`` marks pairs that are no candidates.
    """

    share = 0.0

    def __init__(self, left: np.ndarray, right: np.ndarray, hidden: Callable[[int, int], np.ndarray] | None = None):
        self.left, self.right, self.hidden, self.wide = left, right, hidden, None
        lengths = [np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0)) for x in (left, right)]
        size, dim = lengths[0] * lengths[1], left.shape[1]
        self.slack = 1.01 * (dim + 2) * 2.0**-24 * size + 1e-30 if size < 1e30 else math.nan

    def __len__(self) -> int:
        return len(self.left)

    def whole(self, start: int, stop: int) -> np.ndarray:
        if self.wide is None:
            self.wide = self.right.astype(np.float64).T
        return self.left[start:stop].astype(np.float64) @ self.wide

    def near(self, start: int, stop: int) -> np.ndarray:
        scores = self.whole(start, stop) if math.isnan(self.slack) else self.left[start:stop] @ self.right.T
        if self.hidden is not None:
            scores[self.hidden(start, stop)] = -np.inf
        return scores

    def exact(self, start: int, stop: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        # many pairs, as of copies, cost less as one product
        if rows.size * 16 > (stop - start) * len(self.right):
            return self.whole(start, stop)[rows, columns]
        out = np.empty(rows.size)
        for i in range(0, rows.size, PAIRS_AT_ONCE):
            part = slice(i, i + PAIRS_AT_ONCE)
            left, right = (x[at[part]].astype(np.float64) for x, at in ((self.left[start:stop], rows), (self.right, columns)))
            out[part] = np.einsum("ij,ij->i", left, right)
        return out


class BestLists:
    """The k best items of the queries of a block over all blocks that it has met.

    A query that has k of them has a floor: a later item must have a better score than the
    last one, or the same and a smaller id. So most of a later block is compared once, and neither
    rounded nor sorted.
    """

    def __init__(self, query_ids: np.ndarray, k: int):
        # a copy: a view would hold the whole batch that it came in
        self.query_ids, self.k = np.array(query_ids), k
        self.floors = np.full(query_ids.size, -np.inf)
        self.last_ids = np.full(query_ids.size, np.iinfo(np.int64).max)
        self.rows, self.ids, self.values = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)

    def meet(self, item_ids: np.ndarray, scores: Matrix | Products, decimals: int, at: np.ndarray | None = None) -> None:
        """Take in the scores of a block. ``at`` are the rows of the queries that were scored, all without it."""
        at = np.arange(len(scores)) if at is None else at
        found = [
            self._found(start, min(start + ROWS_AT_ONCE, len(scores)), item_ids, scores, decimals, at)
            for start in range(0, max(1, len(scores)), ROWS_AT_ONCE)
        ]
        rows, ids, values = (np.concatenate(x) for x in zip(*found))
        if rows.size:
            # only lists that something new is in are sorted again
            touched = np.zeros(self.query_ids.size, dtype=bool)
            touched[rows] = True
            old = touched[self.rows]
            new = cut_rows(np.r_[self.rows[old], rows], np.r_[self.ids[old], ids], np.r_[self.values[old], values], self.k)
            ends = np.flatnonzero(np.r_[new[0][1:] != new[0][:-1], True])
            full = ends[np.diff(np.r_[-1, ends]) == self.k]
            self.floors[new[0][full]], self.last_ids[new[0][full]] = new[2][full], new[1][full]
            self.rows, self.ids, self.values = (np.r_[x[~old], y] for x, y in zip((self.rows, self.ids, self.values), new))

    def _found(self, start: int, stop: int, item_ids: np.ndarray, scores: Matrix | Products, decimals: int, at: np.ndarray):
        near, at = scores.near(start, stop), at[start:stop]
        if math.isnan(scores.slack):
            rows, ids, values = best_rows(np.round(near, decimals), item_ids, self.k)
            return at[rows], ids, values
        floors = self.floors[at]
        least = floors.copy()
        new = np.flatnonzero(np.isneginf(floors))
        if new.size and near.shape[1] > self.k:
            place = near.shape[1] - self.k
            least[new] = np.partition(near if new.size == len(near) else near[new], place, axis=1)[:, place]
            least[new] -= scores.slack + scores.share * np.abs(np.nan_to_num(least[new], neginf=0.0))
        # half a unit of the last decimal, and the floats that stand for these numbers
        share = scores.share + 1e-6 * (near.dtype == np.float32)
        least -= scores.slack + 10.0**-decimals + share * np.abs(np.nan_to_num(least, neginf=0.0))
        rows, columns = np.divmod(np.flatnonzero(near >= least.astype(near.dtype)[:, None]), max(1, near.shape[1]))
        there = np.isfinite(near[rows, columns])
        rows, columns = rows[there], columns[there]
        values, ids = np.round(scores.exact(start, stop, rows, columns), decimals), item_ids[columns]
        better = (values > floors[rows]) | ((values == floors[rows]) & (ids < self.last_ids[at][rows]) & np.isfinite(values))
        return at[rows[better]], ids[better], values[better]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[self.rows]), pa.array(self.ids), pa.array(self.values)], schema=RESULT_ARROW
        )


def score_blocks(
    pairs: DataFrame,
    score: Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, Matrix | Products]],
    k: int,
    decimals: int = SCORE_DECIMALS,
) -> DataFrame:
    """Run ``score(batch, row)`` on every block pair and keep the best k per query and task.

    ``score`` returns the ids of the queries, the ids of the items, and the scores of all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, BestLists] = {}
        cell = None

        def flush() -> Iterator[pa.RecordBatch]:
            while best:
                yield best.popitem()[1].batch()

        for batch in batches:
            cells = zip(batch.column("grid_column").to_pylist(), batch.column("grid_row").to_pylist())
            block_ids = batch.column("q_block_id").to_pylist()
            for i, here in enumerate(cells):
                if here != cell:
                    yield from flush()
                    cell = here
                query_ids, item_ids, scores = score(batch, i)
                if block_ids[i] not in best:
                    best[block_ids[i]] = BestLists(query_ids, k)
                best[block_ids[i]].meet(item_ids, scores, decimals)
                del scores
        yield from flush()

    return pairs.mapInArrow(run, RESULT)


def merge_top_k(partial: DataFrame, k: int, rank: str) -> DataFrame:
    """The final k per query over what the tasks kept."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return partial.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def list_values(batch: pa.RecordBatch, name: str, row: int, dtype) -> np.ndarray:
    """One list cell of a batch as a numpy array, without a copy where Arrow allows it."""
    return np.asarray(batch.column(name)[row].values.to_numpy(zero_copy_only=False), dtype=dtype)


def packed_values(batch: pa.RecordBatch, name: str, row: int, dtype, kind=np.int32) -> np.ndarray:
    """One cell of 32-bit numbers that are stored as bytes."""
    return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind).astype(dtype, copy=False)
