"""Which test cases share bugs: for each the k others with the most bugs in common, exactly.

A bug of few links gives its pairs of test cases as rows, which are added up before they are
shuffled: rows in proportion to the links. A join of all links with themselves would let a bug
with a third of all links make nearly all pairs by itself. So the links of bugs with more links than
``LEAST_WIDE`` and than twice the blocks are not paired. Their link matrix (test
cases by bugs) is cut into cells of test-case blocks and bug shards. A task takes two blocks, adds the
products of their cells shard by shard into one small matrix of counts, to which the counted pairs
of the other bugs come, and keeps the
best k of each test case. A hot bug lies in one shard but in all blocks, a hot test case
in one block but in all shards, so neither is ever whole in one place. A link is copied to as many
rows as it would make pairs, or twice the blocks, whichever is less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.functions.numeric import top_k
from rankjobs.operators import blocks
from rankjobs.sources.artifacts import stage

# Test cases per block: a matrix of counts has the square of it.
BLOCK_CASES = 2048
# Links that a cell of a block and a shard holds on average.
CELL_LINKS = 1 << 18
# Bugs of at most this many links are paired by rows.
LEAST_WIDE = 64
# The place of counted pairs before the first shard.
COUNTED = -1
# Pairs of links that are expanded at once inside a task.
AT_ONCE = 1 << 20


def _products(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], counts: np.ndarray) -> None:
    """Add one for every bug that a row of the left and one of the right cell share; cells are (bug, place), sorted by bug."""
    first, last = np.searchsorted(right[0], left[0], "left"), np.searchsorted(right[0], left[0], "right")
    runs = last - first
    used = np.flatnonzero(runs)
    ends = np.cumsum(runs[used])
    begin = 0
    flat = counts.ravel()
    while begin < len(used):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        part = used[begin:stop]
        n = runs[part]
        met = np.arange(int(n.sum())) + np.repeat(first[part] - (np.cumsum(n) - n), n)
        cells = np.repeat(left[1][part], n) * counts.shape[1] + right[1][met]
        np.add.at(flat, cells, 1)
        begin = stop


def _count(k: int, block_cases: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shard = None
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        names: list[dict[int, int]] = [{}, {}]
        counts = np.zeros((block_cases, block_cases), dtype=np.int32)

        def places(side: int, cases: np.ndarray) -> np.ndarray:
            own = names[side]
            return np.fromiter((own.setdefault(c, len(own)) for c in cases.tolist()), np.int64, len(cases))

        def fit() -> None:
            nonlocal counts
            most = max(len(names[0]), len(names[1]))
            if most > len(counts):
                # hashes fill blocks unevenly
                counts = np.pad(counts, (0, 2 * most - len(counts)))

        def end_shard() -> None:
            fit()
            if held[0] and held[1]:
                sides = []
                for side in held:
                    bugs, own = (np.concatenate(x) for x in zip(*side))
                    order = np.argsort(bugs, kind="stable")
                    sides.append((bugs[order], own[order]))
                _products(sides[0], sides[1], counts)
            held[0].clear(), held[1].clear()

        def end_pair() -> Iterator[pa.RecordBatch]:
            end_shard()
            ids = [np.fromiter(n, np.int64, len(n)) for n in names]
            scores = counts[: len(ids[0]), : len(ids[1])].astype(np.float64)
            scores[(scores == 0) | (ids[0][:, None] == ids[1][None, :])] = -np.inf
            if scores.size:
                rows, others, values = blocks.best_rows(scores, ids[1], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[0][rows]), pa.array(others), pa.array(values)], schema=blocks.RESULT_ARROW
                )
            counts[:] = 0
            names[0].clear(), names[1].clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("row", "col", "shard", "side")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), len(batch)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                here = tuple(keys[:2, start])
                if here != pair:
                    if pair is not None:
                        yield from end_pair()
                    pair, shard = here, None
                if shard is not None and keys[2, start] != shard:
                    end_shard()
                shard, side = keys[2, start], int(keys[3, start])
                bugs, cases = (batch.column(c).slice(start, end - start).to_numpy() for c in ("bug_id", "testcase_id"))
                if shard == COUNTED:
                    others, n = (batch.column(c).slice(start, end - start).to_numpy() for c in ("other_id", "n"))
                    at = places(0, cases), places(1, others)
                    fit()
                    np.add.at(counts, at, n.astype(counts.dtype))
                    continue
                held[side].append((bugs, places(side, cases)))
        if pair is not None:
            yield from end_pair()

    return run


def co_occurrence(
    links: DataFrame, k: int = 10, *, block_cases: int = BLOCK_CASES, cell_links: int = CELL_LINKS, least_wide: int = LEAST_WIDE
) -> DataFrame:
    """``testcase_id, other_testcase_id, bugs, rank``: per test case the k others that share most bugs, ties to smaller ids.

    Repeated links count once; links with a missing end count nowhere; a test case
    that shares no bug has no row.
    """
    k = top_k(k)
    pairs = stage(links.select("bug_id", "testcase_id").filter("bug_id is not null and testcase_id is not null").distinct(), "link-pairs")
    n_cases = pairs.select("testcase_id").distinct().count()
    most = max(least_wide, 2 * math.ceil(n_cases / (block_cases * 0.9)))
    wide_bugs = stage(pairs.groupBy("bug_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "wide-bugs")
    n_links = wide_bugs.agg(F.sum("n")).first()[0] or 0
    narrow = pairs.join(wide_bugs, "bug_id", "left_anti") if n_links else pairs
    # at most ``most`` of a bug, so that these lists are short
    own = narrow.groupBy("bug_id").agg(F.collect_list("testcase_id").alias("cases"))
    met = own.select("cases", F.explode("cases").alias("a")).select("a", F.explode("cases").alias("b")).filter("a < b")
    once = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def pair(one: str, other: str):
        return F.struct(F.col(one).alias("testcase_id"), F.col(other).alias("other_id"))

    both_ways = F.explode(F.array(pair("a", "b"), pair("b", "a")))
    counted = once.select(both_ways.alias("p"), "n").select("p.testcase_id", "p.other_id", "n")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
        return (
            found.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select(
                F.col("query_id").alias("testcase_id"), F.col("item_id").alias("other_testcase_id"), F.col("score").cast("bigint").alias("bugs"), "rank"
            )
        )

    def scored(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("testcase_id").alias("query_id"), F.col("other_id").alias("item_id"), F.col("n").cast("double").alias("score"))

    if not n_links:
        return best(scored(counted))
    pairs = stage(pairs.join(wide_bugs, "bug_id", "left_semi"), "wide-links")
    wide = stage(pairs.select("testcase_id").distinct().withColumn("wide", F.lit(True)), "wide-cases")
    n_blocks = max(1, math.ceil(wide.count() / (block_cases * 0.9)))
    n_shards = max(1, math.ceil(n_links / n_blocks / cell_links))
    counted = counted.join(wide, "testcase_id", "left").join(
        wide.select(F.col("testcase_id").alias("other_id"), F.col("wide").alias("other_wide")), "other_id", "left"
    )
    in_cells = F.coalesce(F.col("wide") & F.col("other_wide"), F.lit(False))
    counted = stage(counted.select("testcase_id", "other_id", "n", in_cells.alias("in_cells")), "counted-pairs")

    def dealt(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    cells = pairs.select("bug_id", "testcase_id", dealt("testcase_id", n_blocks).alias("block"), dealt("bug_id", n_shards).alias("shard"))
    no_pair = [F.lit(0).cast("bigint").alias("other_id"), F.lit(0).cast("bigint").alias("n")]
    rows = cells.select(F.col("block").alias("row"), every.alias("col"), "shard", F.lit(0).alias("side"), "bug_id", "testcase_id", *no_pair)
    cols = cells.select(every.alias("row"), F.col("block").alias("col"), "shard", F.lit(1).alias("side"), "bug_id", "testcase_id", *no_pair)
    known = counted.filter("in_cells").select(
        dealt("testcase_id", n_blocks).alias("row"), dealt("other_id", n_blocks).alias("col"), F.lit(COUNTED).alias("shard"),
        F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("bug_id"), "testcase_id", "other_id", "n",
    )
    keys = ["row", "col", "shard", "side"]
    met = rows.unionByName(cols.select(*rows.columns)).unionByName(known)
    met = met.repartition(min(n_blocks * n_blocks, blocks.MAX_PARTITIONS), "row", "col")
    found = met.sortWithinPartitions(*keys).mapInArrow(_count(k, block_cases), blocks.RESULT)
    return best(found.unionByName(scored(counted.filter("not in_cells"))))
