"""Fusion of a dense and a BM25 list per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.functions.numeric import top_k

# The rank constant, and the rank that stands for "not in this list".
RRF_K = 60
ABSENT_RANK = 10**9


def rrf(dense: DataFrame, bm25: DataFrame, k: int, *, by: tuple[str, ...] = ("query_id",), rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion, the k best per query.

    The two lists meet by union and one aggregation, which shuffles each list once
    and has no NULL-key question. Order: fused score, dense score, BM25 score
    (missing last), then the smaller id.
    """
    keys = [*by, "bug_id"]
    nothing = F.lit(None)
    rows = dense.select(
        *keys,
        "dense_score",
        "dense_rank",
        nothing.cast("double").alias("bm25_score"),
        nothing.cast("int").alias("bm25_rank"),
    ).unionByName(
        bm25.select(
            *keys,
            nothing.cast("double").alias("dense_score"),
            nothing.cast("int").alias("dense_rank"),
            "bm25_score",
            "bm25_rank",
        )
    )
    both = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("dense_score", "dense_rank", "bm25_score", "bm25_rank")))
    return keep_best(both.withColumn("hybrid_score", rrf_score(rrf_k)), k, by)


def rrf_score(rrf_k: int = RRF_K):
    def part(rank: str):
        return F.lit(1.0) / (F.lit(float(rrf_k)) + F.coalesce(F.col(rank).cast("double"), F.lit(float(ABSENT_RANK))))

    return part("dense_rank") + part("bm25_rank")


def keep_best(fused: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Number the fused rows per query and cut at k."""
    order = Window.partitionBy(*by).orderBy(
        F.col("hybrid_score").desc(),
        F.col("dense_score").desc_nulls_last(),
        F.col("bm25_score").desc_nulls_last(),
        F.col("bug_id").asc(),
    )
    return fused.withColumn("hybrid_rank", F.row_number().over(order)).filter(F.col("hybrid_rank") <= top_k(k))


def dense_as_hybrid(dense: DataFrame) -> DataFrame:
    """A dense list in the columns of a fused one."""
    return dense.withColumns(
        {
            "bm25_score": F.lit(0.0),
            "bm25_rank": F.lit(None).cast("int"),
            "hybrid_score": F.col("dense_score"),
            "hybrid_rank": F.col("dense_rank"),
        }
    )
