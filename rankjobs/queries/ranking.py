"""Voting, reranking and recommending."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.operators import dense, fuse, rerank, vote
from rankjobs.plans import recommend as rec
from rankjobs.queries import model as m
from rankjobs.queries.retrieval import LINKED_SQL
from rankjobs.sources.artifacts import stage


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


def _neighbours(spark, sf):
    """Nearest given vectors of every given vector, as a hybrid list."""
    vectors = stage(m.vectors(spark, sf), "vectors")
    near = dense.dense_neighbours(
        vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "bug_id"), 10
    )
    return fuse.dense_as_hybrid(near)


def vote_a(spark, sf):
    return _rounded(
        vote.vote_by_position(_neighbours(spark, sf), m.vote_links(spark, sf)), "similarity_sum", "rank_bonus"
    )


def vote_b(spark, sf):
    return _rounded(vote.vote_by_score(_neighbours(spark, sf), m.vote_links(spark, sf)), "aggregated_score")


def vote_c(spark, sf):
    return _rounded(
        vote.vote_by_ballot(_neighbours(spark, sf), m.vote_links(spark, sf)), "similarity_sum", "rank_bonus"
    )


def weighted_vote(spark, sf):
    """Links weighted by how many raw links stand behind them."""
    weights = (
        m.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("bug_id"), (F.col("l_partkey") + m.TESTCASE_BASE).alias("testcase_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("link_weight"))
    )
    titles = m.testcases(spark, sf).select("testcase_id", "testcase_title")
    return _rounded(vote.vote_by_link_weight(_neighbours(spark, sf), weights.join(titles, "testcase_id")), "candidate_score")


def _bug_queries(spark, sf):
    text = tx.enriched_text("bug_title", "bug_tags", "severity", "bug_description")
    return m.bugs(spark, sf).select(F.col("bug_id").alias("query_id"), text.alias("query_text"))


def pair_overlap(spark, sf):
    """Token overlap of every linked bug and test case."""
    pairs = m.vote_links(spark, sf).withColumnRenamed("bug_id", "query_id")
    return _rounded(rerank.token_overlap_scorer(pairs, _bug_queries(spark, sf)), "raw_score")


def rerank_eval(spark, sf):
    retrieved = vote.vote_by_score(_neighbours(spark, sf), m.vote_links(spark, sf))
    out = rerank.rerank_after_cut(retrieved, _bug_queries(spark, sf), rerank.token_overlap_scorer)
    return _rounded(out, "aggregated_score", "retrieval_norm", "reranker_score", "reranker_norm", "final_score")


def rerank_grid(spark, sf):
    candidates = vote.vote_by_ballot(_neighbours(spark, sf), m.vote_links(spark, sf))
    out = rerank.rerank_before_cut(candidates, _bug_queries(spark, sf), rerank.token_overlap_scorer, 0.25)
    return _rounded(out.drop("rank_bonus"), "similarity_sum", "reranker_score", "retrieval_score", "final_score")


def _passage_queries(spark, sf):
    return rec.query_rows(m.table(spark, sf, "benchmark"), "item_id", "text")


def recommend(spark, sf):
    """Passages in, test cases out: vectors, BM25, fusion, vote."""
    _, corpus = m.history(spark, sf)
    queries = _passage_queries(spark, sf)
    return _rounded(
        rec.recommend(queries, m.vectorize_queries(queries), corpus), "similarity_sum", "rank_bonus"
    )


def recommend_dense(spark, sf):
    _, corpus = m.history(spark, sf, words=False)
    queries = _passage_queries(spark, sf)
    config = rec.RecommendConfig(mode="dense")
    return _rounded(
        rec.recommend(queries, m.vectorize_queries(queries), corpus, config), "similarity_sum", "rank_bonus"
    )


def similar_bugs(spark, sf):
    _, corpus = m.history(spark, sf)
    queries = _passage_queries(spark, sf)
    found = rec.similar_bugs(queries, m.vectorize_queries(queries), corpus, rec.RecommendConfig())
    return _rounded(found.withColumn("hybrid_score", F.round("hybrid_score", 9)), "dense_score")


def recommend_reranked(spark, sf):
    _, corpus = m.history(spark, sf)
    queries = _passage_queries(spark, sf)
    _, final = rec.recommend_reranked(queries, m.vectorize_queries(queries), corpus, rerank.token_overlap_scorer)
    return _rounded(final, "aggregated_score", "retrieval_norm", "reranker_score", "reranker_norm", "final_score")


_NEAR = {
    **m.sql_dense("near", "vectors", "vectors", 10),
    "others": m.sql_without_self("near", 10),
    "neighbours": "SELECT query_id, bug_id, dense_score AS hybrid_score, dense_rank AS hybrid_rank FROM others",
}
_VOTE_C = {
    "ballots": """SELECT n.query_id, n.bug_id, n.hybrid_score, l.testcase_id, l.testcase_title,
        row_number() OVER (PARTITION BY n.query_id ORDER BY n.hybrid_rank, l.testcase_id) AS hybrid_rank
        FROM neighbours n JOIN vote_links l ON l.bug_id = n.bug_id""",
    "sums": """SELECT query_id, testcase_id, testcase_title, round(sum(hybrid_score), 9) AS similarity_sum,
        count(DISTINCT bug_id) AS support_count, round(sum(1.0::DOUBLE / hybrid_rank), 9) AS rank_bonus FROM ballots GROUP BY ALL""",
    "scored": """SELECT *, round(0.7::DOUBLE * similarity_sum + 0.2::DOUBLE * support_count + 0.1::DOUBLE * rank_bonus, 12) AS final_score FROM sums""",
}
_WORDS = r"list_distinct(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t)))"


def _overlap_sql(pairs: str, queries: str) -> dict[str, str]:
    """CTE ``overlap`` with a ``raw_score`` for ``pairs``, texts in ``queries(id, text)``."""
    return {
        "query_words": f"SELECT id, {_WORDS.format('text')} AS qw FROM {queries}",
        "overlap": f"""SELECT *, CASE WHEN u > 0 THEN i::DOUBLE / u ELSE 0 END AS raw_score FROM (
            SELECT p.*, len(list_intersect(coalesce(qw, []), tw)) AS i, len(list_distinct(list_concat(coalesce(qw, []), tw))) AS u
            FROM (SELECT *, {_WORDS.format('testcase_title')} AS tw FROM {pairs}) p LEFT JOIN query_words ON id = p.query_id)""",
    }


def _min_max_sql(x: str, by: str = "query_id") -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY {by})", f"max({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {hi} > {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE 1.0 END"


def rerank_eval_sql(source: str, queries: str, by: str = "query_id") -> dict[str, str]:
    """CTE ``reranked`` over a cut list with ``aggregated_score``."""
    return {
        **_overlap_sql(source, queries),
        "squashed": "SELECT *, 1.0::DOUBLE / (1 + exp(-raw_score)) AS reranker_score FROM overlap",
        "normed": f"SELECT *, {_min_max_sql('aggregated_score', by)} AS retrieval_norm, {_min_max_sql('reranker_score', by)} AS reranker_norm FROM squashed",
        "fused_scores": "SELECT *, round(0.5::DOUBLE * retrieval_norm + 0.5::DOUBLE * reranker_norm, 9) AS final_score FROM normed",
        "reranked": f"SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY {by} ORDER BY final_score DESC, testcase_id) AS rank FROM fused_scores",
    }


_ENRICHED_QUERIES = f"SELECT bug_id AS id, {m.sql_enriched(*m.BUG_FIELDS_SQL)} AS text FROM bugs"
_RERANKED = """SELECT query_id, testcase_id, testcase_title, round(aggregated_score, 9) AS aggregated_score, supporting_bug_count,
    round(retrieval_norm, 9) AS retrieval_norm, round(reranker_score, 9) AS reranker_score, round(reranker_norm, 9) AS reranker_norm,
    round(final_score, 9) AS final_score, 'reranked' AS ranking_method, rank FROM reranked"""
_POSITION = """SELECT query_id, testcase_id, testcase_title, round(similarity_sum, 9) AS similarity_sum, support_count,
    round(rank_bonus, 9) AS rank_bonus, final_score, rank FROM"""
_PASSAGES = f"SELECT item_id AS id, {m.sql_enriched('text', chr(39) * 2, chr(39) * 2, chr(39) * 2)} AS text FROM benchmark"


def recommend_ctes(queries: str, depth: int = 50) -> dict[str, str]:
    """From ``queries(id, text)`` to ``fused``, without exclusion."""
    return {
        **LINKED_SQL,
        "queries": queries,
        "prefixed": f"SELECT id, 'query: ' || {m.sql_strip('text')} AS text FROM queries",
        **m.sql_hash_vectors("qv", "prefixed"),
        **m.sql_dense("near", "qv", "cv", depth),
        "others": "SELECT *, raw_rank AS dense_rank FROM near",
        **m.sql_bm25("words", "c", "queries", depth, False),
        **m.sql_rrf("fused", "others", "words", depth),
    }


QUERIES = {
    "vote_a": (vote_a, m.with_ctes(("vectors", "vote_links"), {**_NEAR, **m.sql_vote_position("v", "neighbours", "vote_links")}, f"{_POSITION} v")),
    "vote_b": (
        vote_b,
        m.with_ctes(
            ("vectors", "vote_links"),
            {**_NEAR, **m.sql_vote_score("v", "neighbours", "vote_links")},
            """SELECT query_id, testcase_id, testcase_title, round(aggregated_score, 9) AS aggregated_score, supporting_bug_count, rank FROM v""",
        ),
    ),
    "vote_c": (
        vote_c,
        m.with_ctes(
            ("vectors", "vote_links"),
            {**_NEAR, **_VOTE_C},
            """SELECT query_id, testcase_id, testcase_title, round(similarity_sum, 9) AS similarity_sum, support_count,
            round(rank_bonus, 9) AS rank_bonus, final_score, row_number() OVER (PARTITION BY query_id
            ORDER BY scored.final_score DESC, scored.similarity_sum DESC, support_count DESC, testcase_id) AS rank FROM scored""",
        ),
    ),
    "weighted_vote": (
        weighted_vote,
        m.with_ctes(
            ("vectors", "testcases"),
            {
                **_NEAR,
                "weights": f"""SELECT l_orderkey AS bug_id, l_partkey + {m.TESTCASE_BASE} AS testcase_id, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL""",
                "sums": """SELECT n.query_id, t.testcase_id, t.testcase_title, round(sum(n.hybrid_score * w), 9) AS candidate_score
                FROM neighbours n JOIN weights USING (bug_id) JOIN testcases t USING (testcase_id) GROUP BY ALL""",
                "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY candidate_score DESC, testcase_id) AS rank FROM sums""",
            },
            "SELECT query_id, testcase_id, testcase_title, round(candidate_score, 9) AS candidate_score, rank FROM ranked WHERE rank <= 10",
        ),
    ),
    "pair_overlap": (
        pair_overlap,
        m.with_ctes(
            ("bugs", "vote_links"),
            {
                "queries": _ENRICHED_QUERIES,
                "pairs": "SELECT bug_id AS query_id, testcase_id, testcase_title FROM vote_links",
                **_overlap_sql("pairs", "queries"),
            },
            "SELECT query_id, testcase_id, testcase_title, round(raw_score, 9) AS raw_score FROM overlap",
        ),
    ),
    "rerank_eval": (
        rerank_eval,
        m.with_ctes(
            ("vectors", "vote_links"),
            {
                **_NEAR,
                **m.sql_vote_score("v", "neighbours", "vote_links"),
                "queries": _ENRICHED_QUERIES,
                **rerank_eval_sql("v", "queries"),
            },
            _RERANKED,
        ),
    ),
    "rerank_grid": (
        rerank_grid,
        m.with_ctes(
            ("vectors", "vote_links"),
            {
                **_NEAR,
                **_VOTE_C,
                "queries": _ENRICHED_QUERIES,
                **_overlap_sql("scored", "queries"),
                "normed": f"SELECT *, {_min_max_sql('raw_score')} AS reranker_score, {_min_max_sql('final_score')} AS retrieval_score FROM overlap",
                "fused_scores": """SELECT * EXCLUDE (final_score), round((1 - 0.25::DOUBLE) * retrieval_score + 0.25::DOUBLE * reranker_score, 9)
                AS final_score FROM normed""",
                "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, testcase_id) AS rank FROM fused_scores",
            },
            """SELECT query_id, testcase_id, testcase_title, round(similarity_sum, 9) AS similarity_sum, support_count,
            round(reranker_score, 9) AS reranker_score, round(retrieval_score, 9) AS retrieval_score,
            round(final_score, 9) AS final_score, 'reranked' AS ranking_method, rank FROM ranked WHERE rank <= 10""",
        ),
    ),
    "recommend": (
        recommend,
        m.with_ctes(
            ("metadata",), {**recommend_ctes(_PASSAGES), **m.sql_vote_position("v", "fused", "vote_links")}, f"{_POSITION} v"
        ),
    ),
    "recommend_dense": (
        recommend_dense,
        m.with_ctes(
            ("metadata",),
            {
                **recommend_ctes(_PASSAGES, 10),
                "neighbours": "SELECT query_id, bug_id, dense_score AS hybrid_score, dense_rank AS hybrid_rank FROM others",
                **m.sql_vote_position("v", "neighbours", "vote_links"),
            },
            f"{_POSITION} v",
        ),
    ),
    "similar_bugs": (
        similar_bugs,
        m.with_ctes(
            ("metadata",),
            recommend_ctes(_PASSAGES),
            """SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, dense_rank, bm25_score, bm25_rank,
            round(hybrid_score, 9) AS hybrid_score, hybrid_rank FROM fused""",
        ),
    ),
    "recommend_reranked": (
        recommend_reranked,
        m.with_ctes(
            ("metadata",),
            {
                **recommend_ctes(_PASSAGES),
                **m.sql_vote_score("v", "fused", "vote_links"),
                **rerank_eval_sql("v", "queries"),
            },
            _RERANKED,
        ),
    ),
}
