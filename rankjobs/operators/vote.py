"""Neighbours to test cases: each neighbour votes for what it is linked to.

A neighbour frame has ``query_id, bug_id``, a score and a 1-based position. Links are
``bug_id, testcase_id, testcase_title``. Sums are rounded to nine decimals before they
are compared, so that equal ones tie however Spark groups the additions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.functions.numeric import top_k
from rankjobs.operators.blocks import SCORE_DECIMALS, SUM_DECIMALS


# Test-case ids per range when the links of a bug are numbered.
IDS_PER_RANGE = 1 << 16


@dataclass(frozen=True)
class VoteWeights:
    similarity: float = 0.70
    support: float = 0.20
    rank: float = 0.10


def _rounded(value: Column) -> Column:
    return F.round(value, SCORE_DECIMALS)


def counted_links(links: DataFrame, distinct: bool = True) -> DataFrame:
    """Links with a title, once each, with the number of ``copies`` that vote."""
    titled = links.select("bug_id", "testcase_id", "testcase_title").filter("testcase_title is not null")
    if distinct:
        return titled.distinct().withColumn("copies", F.lit(1))
    return titled.groupBy("bug_id", "testcase_id", "testcase_title").agg(F.count(F.lit(1)).alias("copies"))


def ballots(neighbours: DataFrame, links: DataFrame, score: str, position: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row per neighbour and counted link."""
    return neighbours.select(
        *by, "bug_id", F.col(score).alias("score"), F.col(position).cast("double").alias("position")
    ).join(links, "bug_id")


def tally(votes: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Sum of scores, number of supporting bugs, and rank bonus per candidate.

    A (candidate, bug) pair is one ballot, so counting ballots counts bugs and one
    aggregation does it all.
    """
    return votes.groupBy(*by, "testcase_id", "testcase_title").agg(
        _rounded(F.sum(F.col("score") * F.col("copies"))).alias("similarity_sum"),
        F.count(F.lit(1)).alias("support_count"),
        _rounded(F.sum(F.col("copies") / F.col("position"))).alias("rank_bonus"),
    )


def weighted(tallied: DataFrame, weights: VoteWeights = VoteWeights()) -> DataFrame:
    final = (
        F.lit(weights.similarity) * F.col("similarity_sum")
        + F.lit(weights.support) * F.col("support_count")
        + F.lit(weights.rank) * F.col("rank_bonus")
    )
    return tallied.withColumn("final_score", F.round(final, SUM_DECIMALS))


def ranked(scored: DataFrame, order_by: tuple[str, ...], k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Number the candidates per query, best first, and cut at k where one is given."""
    order = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order_by), F.col("testcase_id").asc())
    numbered = scored.withColumn("rank", F.row_number().over(order))
    return numbered if k is None else numbered.filter(F.col("rank") <= top_k(k))


def vote_by_position(
    neighbours: DataFrame,
    links: DataFrame,
    k: int = 10,
    *,
    score: str = "hybrid_score",
    position: str = "hybrid_rank",
    weights: VoteWeights = VoteWeights(),
) -> DataFrame:
    """The variant for recommending: a candidate gains from the ranks of the bugs behind it.

    Links are taken as they are; a repeated link votes again.
    """
    counted = weighted(tally(ballots(neighbours, counted_links(links, distinct=False), score, position)), weights)
    return ranked(counted, ("final_score", "similarity_sum", "support_count"), k)


def vote_by_score(
    neighbours: DataFrame, links: DataFrame, k: int = 10, *, score: str = "hybrid_score", by: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """The variant for evaluation: distinct links, score sum first, then support."""
    votes = ballots(
        neighbours.withColumn("_position", F.lit(1)),
        counted_links(links),
        score,
        "_position",
        by,
    )
    counted = (
        tally(votes, by)
        .withColumnsRenamed({"similarity_sum": "aggregated_score", "support_count": "supporting_bug_count"})
        .drop("rank_bonus")
    )
    return ranked(counted, ("aggregated_score", "supporting_bug_count"), k, by)


def ranked_links(links: DataFrame) -> DataFrame:
    """Distinct links with ``link_rank``, their place among the links of their bug by
    test-case id, and ``link_count``, how many the bug has.

    A bug may hold a large part of all links, so its links are not numbered in one
    window. They fall into ranges of ids; a window numbers the at most
    ``IDS_PER_RANGE`` ids of a range, and another one adds up the few ranges of a bug.
    """
    distinct = (
        links.select("bug_id", "testcase_id", "testcase_title")
        .distinct()
        .withColumn("_range", F.floor(F.col("testcase_id") / IDS_PER_RANGE))
    )
    sizes = distinct.groupBy("bug_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bug_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "bug_id",
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("bug_id")).alias("link_count"),
    )
    within = Window.partitionBy("bug_id", "_range").orderBy("testcase_id", "testcase_title")
    return (
        distinct.withColumn("_place", F.row_number().over(within))
        .join(sizes, ["bug_id", "_range"])
        .select("bug_id", "testcase_id", "testcase_title", (F.col("_before") + F.col("_place")).alias("link_rank"), "link_count")
    )


def numbered_ballots(
    neighbours: DataFrame, links: DataFrame, score: str, position: str, by: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Ballots whose position is their place in the list of all ballots of the query:
    by neighbour, then by link. ``links`` come from ``ranked_links``.

    The place is the number of links of the neighbours before plus the link's own
    rank, so that only the short neighbour lists are sorted per query.
    """
    counts = links.select("bug_id", "link_count").distinct()
    before = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        neighbours.select(*by, "bug_id", F.col(score).alias("score"), F.col(position).alias("position"))
        .join(counts, "bug_id")
        .withColumn("_start", F.coalesce(F.sum("link_count").over(before), F.lit(0)))
        .select(*by, "bug_id", "score", "_start")
    )
    # a link without a title takes a place, but is no candidate
    return (
        placed.join(links.filter("testcase_title is not null").drop("link_count"), "bug_id")
        .withColumn("position", (F.col("_start") + F.col("link_rank")).cast("double"))
        .withColumn("copies", F.lit(1))
        .drop("_start", "link_rank")
    )


def vote_by_ballot(
    neighbours: DataFrame,
    links: DataFrame,
    *,
    score: str = "hybrid_score",
    position: str = "hybrid_rank",
    weights: VoteWeights = VoteWeights(),
    k: int | None = None,
) -> DataFrame:
    """The variant for tuning: the rank bonus runs over ballots, and nothing is cut by default."""
    votes = numbered_ballots(neighbours, ranked_links(links), score, position)
    return ranked(weighted(tally(votes), weights), ("final_score", "similarity_sum", "support_count"), k)


def vote_by_link_weight(
    neighbours: DataFrame, links: DataFrame, k: int = 10, *, score: str = "hybrid_score", weight: str = "link_weight"
) -> DataFrame:
    """Sum of score times link weight (planned in the specification, not in its code)."""
    voted = neighbours.select("query_id", "bug_id", F.col(score).alias("score")).join(
        links.filter("testcase_title is not null"), "bug_id"
    )
    counted = voted.groupBy("query_id", "testcase_id", "testcase_title").agg(
        _rounded(F.sum(F.col("score") * F.col(weight))).alias("candidate_score")
    )
    return ranked(counted, ("candidate_score",), k)
