"""Second-stage scores for (query text, test-case title) pairs, and their fusion.

A scorer takes pairs ``query_id, testcase_id, testcase_title`` and the queries, and
returns the pairs with a ``raw_score``. A failing scorer fails the job; ``None`` as
scorer means "keep the retrieval order". Reranking never drops a member of a list: a
query without a text has an empty one, a pair without a stored score has 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.functions.numeric import min_max, sigmoid, with_min_max
from rankjobs.operators.blocks import SCORE_DECIMALS
from rankjobs.operators.vote import ranked
from rankjobs.sources.artifacts import stage

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def jaccard(short: Column, long: Column, size: Column | None = None) -> Column:
    """Shared over all tokens of two sets; two empty sets give 0. The hash set that
    Spark builds is that of the second argument, so that is the short one. ``size`` is that of a
    long set of which only the tokens are there that any short one has."""
    shared = F.size(F.array_intersect(long, short))
    union = F.size(short) + (F.size(long) if size is None else size) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def token_overlap_scorer(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """The built-in scorer: Jaccard overlap of tokens, in native expressions.

    The long query texts are cut into tokens once per query, and of these only the ones that some title
    has go along with the pairs, next to the number of all; the short titles are cut
    per pair, which costs less than bringing them in by a join on the title.
    """
    title = F.array_distinct(tx.tokenize("testcase_title"))
    # rows and not ids are numbered, since an id may come twice
    rows = queries.select("query_id", F.array_distinct(tx.tokenize("query_text")).alias("_tokens"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "query-tokens")
    words = pairs.select("testcase_title").distinct().select(F.explode(title).alias("_token")).distinct()
    known = (
        rows.select("_row", F.explode("_tokens").alias("_token"))
        .join(words, "_token", "left_semi")
        .groupBy("_row")
        .agg(F.collect_list("_token").alias("_known"))
    )
    own = stage(rows.select("query_id", "_row", F.size("_tokens").alias("_size")).join(known, "_row", "left").drop("_row"), "query-words")
    shared = F.coalesce("_known", F.array().cast("array<string>"))
    return (
        pairs.join(own, "query_id", "left")
        .withColumn("raw_score", jaccard(title, shared, F.coalesce("_size", F.lit(0))))
        .drop("_known", "_size")
    )


def python_scorer(make_model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch_size: int = 32) -> Scorer:
    """A scorer around a Python model, which each task loads once."""

    def score(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        joined = pairs.join(queries.select("query_id", "query_text"), "query_id", "left")
        kept = pairs.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make_model()
            for frame in frames:
                texts = list(zip(frame["query_text"].fillna(""), frame["testcase_title"].fillna("")))
                scores: list[float] = []
                for start in range(0, len(texts), batch_size):
                    scores += [float(s) for s in model(texts[start : start + batch_size])]
                yield frame[kept].assign(raw_score=scores)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return joined.select(*kept, "query_text").mapInPandas(run, f"{schema}, raw_score double")

    return score


def stored_scorer(scores: DataFrame) -> Scorer:
    """Scores computed elsewhere, as ``query_id, testcase_id, raw_score``."""

    def score(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        known = scores.select("query_id", "testcase_id", "raw_score")
        return pairs.join(known, ["query_id", "testcase_id"], "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0)))

    return score


def _rounded(value: Column) -> Column:
    return F.round(value, SCORE_DECIMALS)


def rerank_after_cut(
    retrieved: DataFrame, queries: DataFrame, scorer: Scorer | None, *, by: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """The evaluation variant: half retrieval, half sigmoid of the scorer, both min-max scaled.

    It reorders a list that is already cut, so membership of the list stays.
    """
    base = retrieved.drop("rank").withColumn("retrieval_norm", min_max("aggregated_score", by))
    if scorer is None:
        empty = F.lit(None).cast("double")
        scored = base.withColumns(
            {
                "reranker_score": empty,
                "reranker_norm": empty,
                "final_score": _rounded(F.col("retrieval_norm")),
                "ranking_method": F.lit("retrieval"),
            }
        )
        return ranked(scored, ("final_score", "aggregated_score", "supporting_bug_count"), None, by)
    scored = (
        scorer(base, queries)
        .withColumn("reranker_score", sigmoid("raw_score"))
        .withColumn("reranker_norm", min_max("reranker_score", by))
        .withColumn("final_score", _rounded(0.5 * F.col("retrieval_norm") + 0.5 * F.col("reranker_norm")))
        .withColumn("ranking_method", F.lit("reranked"))
        .drop("raw_score")
    )
    return ranked(scored, ("final_score",), None, by)


def rerank_before_cut(
    candidates: DataFrame,
    queries: DataFrame,
    scorer: Scorer | None,
    weight: float,
    k: int | None = 10,
    *,
    by: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """The tuning variant: ``(1 - w)`` scaled retrieval plus ``w`` scaled raw score, over all candidates."""
    base = candidates.drop("rank")
    if scorer is None:
        unscored = base.withColumns(
            {"reranker_score": F.lit(None).cast("double"), "ranking_method": F.lit("retrieval")}
        )
        return ranked(unscored, ("final_score", "similarity_sum", "support_count"), k, by)
    # the lists are not cut yet, so their bounds come from an aggregation
    scored = stage(scorer(base, queries), "rerank-scores")
    scored = (
        with_min_max(scored, {"reranker_score": "raw_score", "retrieval_score": "final_score"}, by)
        .withColumn(
            "final_score", _rounded((1 - F.lit(weight)) * F.col("retrieval_score") + F.lit(weight) * F.col("reranker_score"))
        )
        .withColumn("ranking_method", F.lit("reranked"))
        .drop("raw_score")
    )
    return ranked(scored, ("final_score",), k, by)
