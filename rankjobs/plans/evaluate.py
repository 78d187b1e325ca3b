"""Leave-one-out evaluation: every linked bug asks, and its own links are the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.operators import bm25, dense, fuse, rerank, vote
from rankjobs.plans.recommend import Corpus, RecommendConfig
from rankjobs.sources.artifacts import stage

CUTOFFS = (1, 3, 5, 10)
METHODS = ("baseline", "reranked", "hybrid", "hybrid_reranked")


def metric_columns(hit_rank: Column) -> list[Column]:
    """Hit@k and reciprocal rank from the rank of the first true item, NULL when it is not in the list."""
    hits = [F.coalesce((hit_rank <= k).cast("int"), F.lit(0)).alias(f"hit@{k}") for k in CUTOFFS]
    return [*hits, F.coalesce(F.lit(1.0) / hit_rank, F.lit(0.0)).alias("mrr")]


def first_hits(predicted: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank of the first true item per list; lists without one have no row."""
    true_pairs = truth.select("query_id", "testcase_id").distinct()
    return predicted.join(true_pairs, ["query_id", "testcase_id"]).groupBy(*by).agg(F.min("rank").alias("hit_rank"))


def metrics_per_query(predicted: DataFrame, truth: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One metric row per evaluated query, zeros for a query whose list has no hit."""
    hits = first_hits(predicted, truth, ["query_id"])
    return evaluated.join(hits, "query_id", "left").select("query_id", *metric_columns(F.col("hit_rank")))


def metric_means(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric, and the number of queries behind it."""
    names = [f"hit@{k}" for k in CUTOFFS] + ["mrr"]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *(F.avg(f"`{n}`").alias(n) for n in names))


def evaluated_queries(metadata: DataFrame, truth: DataFrame) -> DataFrame:
    """Bugs that have metadata and at least one true item."""
    asked = truth.filter("testcase_id is not null").select("query_id").distinct()
    return asked.join(metadata.select(F.col("bug_id").alias("query_id")), "query_id", "left_semi")


def leave_one_out_lists(
    metadata: DataFrame,
    query_vectors: DataFrame,
    corpus: Corpus,
    scorer: rerank.Scorer | None = None,
    config: RecommendConfig = RecommendConfig(),
) -> DataFrame:
    """The ranked lists of the four methods for every bug, long form with ``method``.

    ``query_vectors`` are those of the same bugs as queries. Each text is retrieved
    once, at the largest depth; the shallow list is a cut of the deep one. The
    candidates are staged, since four methods use them.
    """
    queries = metadata.select(F.col("bug_id").alias("query_id"), F.col("bug_text_enriched").alias("query_text"))
    depth = max(config.bugs, config.hybrid_bugs)
    near = stage(dense.dense_top_k(query_vectors, corpus.vectors, depth), "dense-lists")
    words = bm25.bm25_top_k(None, corpus.index, depth, exclude_self=True)

    shallow = fuse.dense_as_hybrid(dense.without_self(near, config.bugs))
    deep = fuse.rrf(dense.without_self(near, depth), words, depth)
    by = ("method", "query_id")
    neighbours = stage(
        shallow.select(F.lit("baseline").alias("method"), "query_id", "bug_id", "hybrid_score").unionByName(
            deep.select(F.lit("hybrid").alias("method"), "query_id", "bug_id", "hybrid_score")
        ),
        "neighbours",
    )
    retrieved = stage(vote.vote_by_score(neighbours, corpus.links, config.testcases, by=by), "retrieved")
    plain = rerank.rerank_after_cut(retrieved, queries, None, by=by)
    again = rerank.rerank_after_cut(retrieved, queries, scorer, by=by)
    second = F.when(F.col("method") == "baseline", "reranked").otherwise("hybrid_reranked")
    return plain.unionByName(again.withColumn("method", second))


def as_of_lists(query_vectors: DataFrame, corpus: Corpus, moments: DataFrame, config: RecommendConfig = RecommendConfig()) -> DataFrame:
    """Ranked test cases for every bug from the history before it: neighbours are strictly earlier bugs, with their links.

    ``moments`` has ``bug_id`` and a timestamp or date ``time``. A bug without one is
    history for all others and has none itself.
    """
    times = moments.select("bug_id", F.unix_micros(F.col("time").cast("timestamp")).alias("moment"))
    asking = query_vectors.join(times.withColumnRenamed("bug_id", "query_id"), "query_id")
    near = dense.dense_top_k_before(asking, corpus.vectors.join(times, "bug_id"), config.bugs)
    return vote.vote_by_score(near, corpus.links, config.testcases, score="dense_score")


def evaluate(lists: DataFrame, truth: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Metrics per method and query, for every evaluated query under every method."""
    slots = evaluated.select("query_id", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    hits = first_hits(lists, truth, ["method", "query_id"])
    return slots.join(hits, ["method", "query_id"], "left").select(
        "method", "query_id", *metric_columns(F.col("hit_rank"))
    )


def summary(per_query: DataFrame) -> DataFrame:
    return metric_means(per_query, ["method"])


def per_bug_table(lists: DataFrame, truth: DataFrame, evaluated: DataFrame, use_reranker: bool) -> DataFrame:
    """One row per bug: truth, the predictions of each method, metrics and scores of the active one.

    Lists are at most as long as the test-case cut, and one aggregation builds all of them.
    """
    active = "hybrid_reranked" if use_reranker else "hybrid"

    def in_order(method: str, value: Column) -> Column:
        own = F.when(F.col("method") == method, F.struct(F.col("rank"), value.alias("v")))
        return F.transform(F.array_sort(F.collect_list(own)), lambda s: s["v"])

    predictions = lists.groupBy("query_id").agg(
        in_order("baseline", F.col("testcase_id")).alias("baseline_predicted_testcases"),
        in_order("reranked", F.col("testcase_id")).alias("dense_reranked_predicted_testcases"),
        in_order("hybrid", F.col("testcase_id")).alias("hybrid_predicted_testcases"),
        in_order("hybrid_reranked", F.col("testcase_id")).alias("hybrid_reranked_predicted_testcases"),
        in_order(active, F.col("aggregated_score")).alias("retrieval_scores"),
        in_order(active, F.col("reranker_score")).alias("reranker_scores"),
        in_order(active, F.col("final_score")).alias("final_scores"),
    )
    expected = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("testcase_id")).alias("ground_truth_testcases"))
    metrics = metrics_per_query(lists.filter(F.col("method") == active), truth, evaluated)
    table = metrics.join(expected, "query_id").join(predictions, "query_id", "left")
    lists_or_empty = {
        c: F.coalesce(c, F.array().cast(predictions.schema[c].dataType)) for c in predictions.columns if c != "query_id"
    }
    return table.withColumns(lists_or_empty).select(
        F.col("query_id").alias("bug_id"),
        "ground_truth_testcases",
        "baseline_predicted_testcases",
        "dense_reranked_predicted_testcases",
        "hybrid_predicted_testcases",
        "hybrid_reranked_predicted_testcases",
        F.col(f"{active}_predicted_testcases").alias("predicted_testcases"),
        *(f"hit@{k}" for k in CUTOFFS),
        "mrr",
        F.lit("hybrid+reranked" if use_reranker else "hybrid").alias("ranking_method"),
        "retrieval_scores",
        "reranker_scores",
        "final_scores",
    )


def time_split(
    rows: DataFrame, time_column: str, at=None, share: float = 0.8, undated: str = "before"
) -> tuple[DataFrame, DataFrame]:
    """Rows before a moment and rows from it on (planned in the specification, not in its code).

    Without ``at`` the moment is the ``share`` quantile of the times. Rows without a time
    go to the part that ``undated`` names, ``"before"`` or ``"after"``.
    """
    if undated not in ("before", "after"):
        raise ValueError(f"unknown part: {undated!r}")
    if at is None:
        at = rows.agg(F.percentile_approx(F.unix_micros(F.col(time_column).cast("timestamp")), share)).first()[0]
        moment = F.timestamp_micros(F.lit(at))
    else:
        moment = F.lit(at).cast("timestamp")
    early = F.coalesce(F.col(time_column) < moment, F.lit(undated == "before"))
    return rows.filter(early), rows.filter(~early)
