"""From query rows to recommended test cases, for a whole table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.operators import bm25, dense, fuse, rerank, vote
from rankjobs.sources.tables import with_column_if_missing


@dataclass(frozen=True)
class RecommendConfig:
    mode: str = "hybrid"  # or "dense"
    bugs: int = 10
    # hybrid lists are never shorter than this
    hybrid_bugs: int = 50
    testcases: int = 10
    weights: vote.VoteWeights = field(default_factory=vote.VoteWeights)

    @property
    def depth(self) -> int:
        if self.mode not in ("dense", "hybrid"):
            raise ValueError(f"unknown retrieval mode: {self.mode!r}")
        return self.bugs if self.mode == "dense" else max(self.bugs, self.hybrid_bugs)


@dataclass(frozen=True)
class Corpus:
    """What recommending needs from history: unit vectors (as rows or packed), a BM25 index, links."""

    vectors: DataFrame | dense.PackedVectors
    index: bm25.Bm25Index | None
    links: DataFrame


def bug_metadata(bugs: DataFrame, **text_options) -> DataFrame:
    """Bugs with their derived texts; columns that a stored table already has are kept."""
    bugs = with_column_if_missing(bugs, "normalized_bug_title", tx.normalize_title("bug_title"))
    return with_column_if_missing(
        bugs,
        "bug_text_enriched",
        tx.enriched_text("bug_title", "bug_tags", "severity", "bug_description", **text_options),
    )


def query_rows(
    queries: DataFrame, query_id: str, title: str, tags: str | None = None, severity: str | None = None, description: str | None = None
) -> DataFrame:
    """``query_id, query_text`` for rows that have a text and, optionally, metadata."""

    def part(name: str | None):
        return F.lit("") if name is None else F.col(name)

    return queries.select(
        F.col(query_id).cast("bigint").alias("query_id"),
        tx.enriched_text(F.col(title), part(tags), part(severity), part(description)).alias("query_text"),
    )


def similar_bugs(
    queries: DataFrame, query_vectors: DataFrame, corpus: Corpus, config: RecommendConfig, *, exclude_self: bool = False
) -> DataFrame:
    """Ranked neighbours with ``hybrid_score`` and ``hybrid_rank`` in either mode."""
    depth = config.depth
    near = dense.dense_neighbours(query_vectors, corpus.vectors, depth, exclude="after" if exclude_self else "none")
    if config.mode == "dense":
        return fuse.dense_as_hybrid(near)
    if corpus.index is None:
        raise ValueError("hybrid retrieval needs a BM25 index")
    words = bm25.bm25_top_k(queries, corpus.index, depth, exclude_self=exclude_self)
    return fuse.rrf(near, words, depth)


def recommend(
    queries: DataFrame,
    query_vectors: DataFrame,
    corpus: Corpus,
    config: RecommendConfig = RecommendConfig(),
    *,
    exclude_self: bool = False,
) -> DataFrame:
    """The best test cases of every query, by the position-weighted vote."""
    neighbours = similar_bugs(queries, query_vectors, corpus, config, exclude_self=exclude_self)
    return vote.vote_by_position(neighbours, corpus.links, config.testcases, weights=config.weights)


def recommend_reranked(
    queries: DataFrame,
    query_vectors: DataFrame,
    corpus: Corpus,
    scorer: rerank.Scorer | None,
    config: RecommendConfig = RecommendConfig(),
    *,
    exclude_self: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The list by score vote, and the same list in its final order."""
    neighbours = similar_bugs(queries, query_vectors, corpus, config, exclude_self=exclude_self)
    retrieved = vote.vote_by_score(neighbours, corpus.links, config.testcases)
    return retrieved, rerank.rerank_after_cut(retrieved, queries, scorer)
