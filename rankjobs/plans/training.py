"""Training data for rankers from the link fact, pair features, and a learned ranker.

The specification plans these; its code does not have them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rankjobs.functions import text as tx
from rankjobs.operators import vote
from rankjobs.operators.rerank import jaccard
from rankjobs.sources.artifacts import stage

FEATURES = ("area_match", "priority_match", "tag_overlap", "recency")
PATH_FEATURES = ("area_depth", *FEATURES)

# Spark looks for a tree's thresholds in the square of its bins of rows, or in so many, and takes a sample of more.
MAX_BINS = 32
THRESHOLD_ROWS = 10_000


def training_pairs(links: DataFrame, bugs: DataFrame, testcases: DataFrame) -> DataFrame:
    """Linked pairs with both texts, once each. Ids are joined first and wide texts last."""
    pairs = links.select("bug_id", "testcase_id").distinct()
    return pairs.join(testcases.select("testcase_id", F.col("testcase_title").alias("testcase_text")), "testcase_id").join(
        bugs.select("bug_id", F.col("bug_text_enriched").alias("bug_text")), "bug_id"
    ).select("bug_id", "testcase_id", "bug_text", "testcase_text")


def hard_negatives(neighbours: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    """Per bug the k test cases that its neighbours vote for most and that it has no link to.

    ``neighbours`` are bounded lists, so this is no join of all pairs; own links go
    before the cut. Returns ``bug_id, testcase_id, score, rank``.
    """
    votes = vote.vote_by_score(neighbours, links, k=None).drop("rank")
    own = links.select(F.col("bug_id").alias("query_id"), "testcase_id").distinct()
    others = votes.join(own, ["query_id", "testcase_id"], "left_anti")
    return vote.ranked(others, ("aggregated_score", "supporting_bug_count"), k).select(
        F.col("query_id").alias("bug_id"), "testcase_id", F.col("aggregated_score").alias("score"), "rank"
    )


def pair_features(
    pairs: DataFrame,
    bugs: DataFrame,
    testcases: DataFrame,
    *,
    area: tuple[Column, Column],
    priority: tuple[Column, Column],
    tags: tuple[Column, Column],
    time: Column,
    half_life_days: float = 365.0,
    separator: str = "\\",
) -> DataFrame:
    """``pairs`` with equal areas, depth of the shared area, equal priorities, overlap of tags, and recency of the bug.

    Each pair of expressions is one over ``bugs`` and one over ``testcases``. Areas are
    paths; ``area_depth`` is the number of steps that two of them share from the root. Tags
    are one text, of which words are compared, or an array, of which elements are. A
    missing value matches nothing and shares no step. Recency halves every ``half_life_days`` before the latest time;
    it is 0 without a time.
    """

    def words(df: DataFrame, value: Column) -> Column:
        listed = isinstance(df.select(value.alias("v")).schema["v"].dataType, ArrayType)
        return F.array_distinct(F.coalesce(F.array_compact(value), F.array().cast("array<string>")) if listed else tx.tokenize(value))

    latest = bugs.agg(F.max(time)).scalar()
    age = F.datediff(latest, time)
    left = bugs.select(
        "bug_id", area[0].alias("_area"), priority[0].alias("_priority"), words(bugs, tags[0]).alias("_tags"),
        tx.path_parts(area[0], separator).alias("_path"),
        F.coalesce(F.pow(F.lit(0.5), age / F.lit(half_life_days)), F.lit(0.0)).alias("recency"),
    )
    right = testcases.select(
        "testcase_id", area[1].alias("_other_area"), priority[1].alias("_other_priority"),
        words(testcases, tags[1]).alias("_other_tags"), tx.path_parts(area[1], separator).alias("_other_path"),
    )

    def match(a: str, b: str) -> Column:
        return F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))

    return pairs.join(left, "bug_id").join(right, "testcase_id").select(
        *(F.col(c) for c in pairs.columns),
        match("_area", "_other_area").alias("area_match"),
        tx.common_depth(F.col("_path"), F.col("_other_path")).alias("area_depth"),
        match("_priority", "_other_priority").alias("priority_match"),
        jaccard(F.col("_tags"), F.col("_other_tags")).alias("tag_overlap"),
        "recency",
    )


def _fit_pairs(positives: DataFrame, negatives: DataFrame, features: Sequence[str], fit_rows: int | None) -> DataFrame:
    """The features of the pairs of both kinds with ``label``: of all pairs, or of ``fit_rows`` of each kind where a caller asks for so few."""

    def kind(rows: DataFrame, label: float) -> DataFrame:
        if fit_rows is not None:
            order = [F.xxhash64("bug_id", "testcase_id"), F.col("bug_id"), F.col("testcase_id")]
            rows = rows.orderBy(*order).limit(fit_rows)
        return rows.select(*features).withColumn("label", F.lit(label))

    return kind(positives, 1.0).unionByName(kind(negatives, 0.0))


def fit_ranker(
    positives: DataFrame, negatives: DataFrame, features: Sequence[str] = FEATURES, fit_rows: int | None = None
) -> LogisticRegressionModel:
    """A logistic model of pairs with features, fit on all of them."""
    rows = _fit_pairs(positives, negatives, features, fit_rows)
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    return LogisticRegression(featuresCol="_features", regParam=1e-3).fit(assembled)


def fit_tree_ranker(
    positives: DataFrame,
    negatives: DataFrame,
    features: Sequence[str] = FEATURES,
    fit_rows: int | None = None,
    trees: int = 20,
    depth: int = 3,
) -> GBTRegressionModel | None:
    """Boosted regression trees that tell linked pairs (1) from hard negatives (0), fit on all of them.

    Many pairs are counted first, and those of equal features and kind come as one row with that weight;
    there are as many bins as it takes for Spark to look for thresholds in all of these rows. Few pairs are taken one by one
    in the order of a hash, so that equally good splits fall alike. The rows are staged, since every tree reads them.
    None without a pair of each kind.
    """
    pairs = stage(_fit_pairs(positives, negatives, features, fit_rows), "ranker-pairs")
    n, bins = pairs.count(), MAX_BINS
    if n > THRESHOLD_ROWS:
        counted = pairs.groupBy(*features, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        rows = stage(counted, "ranker-rows")
        if (m := rows.count()) > THRESHOLD_ROWS:
            bins = max(MAX_BINS, math.isqrt(m) + 1)
    else:
        every = _fit_pairs(positives, negatives, features, max(n, 1) if fit_rows is None else fit_rows)
        rows = stage(every.withColumn("weight", F.lit(1.0)), "ranker-rows")
    if rows.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    return GBTRegressor(
        featuresCol="_features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.2, seed=7
    ).fit(assembled)


def scored_pairs(
    pairs: DataFrame, model: LogisticRegressionModel | GBTRegressionModel | None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """All pairs with ``ranker_score`` between 0 and 1; without a model it is 0.5."""
    if model is None:
        return pairs.withColumn("ranker_score", F.lit(0.5))
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(pairs)
    scored = model.transform(assembled)
    if isinstance(model, GBTRegressionModel):
        score = F.greatest(F.least(F.col("prediction"), F.lit(1.0)), F.lit(0.0))
    else:
        score = vector_to_array("probability")[1]
    return scored.withColumn("ranker_score", score).select(*pairs.columns, "ranker_score")


def rank_pairs(
    pairs: DataFrame, model: LogisticRegressionModel | GBTRegressionModel | None, retrieval_score: str, weight: float = 0.5,
    k: int | None = 10, features: Sequence[str] = FEATURES,
) -> DataFrame:
    """All pairs by ``(1 - weight)`` times their retrieval score plus ``weight`` times the ranker's."""
    final = F.round((1 - F.lit(weight)) * F.col(retrieval_score) + F.lit(weight) * F.col("ranker_score"), 9)
    kept = scored_pairs(pairs, model, features).withColumn("final_score", final)
    return vote.ranked(kept, ("final_score",), k, ("bug_id",))


def candidates(neighbours: DataFrame, links: DataFrame) -> DataFrame:
    """Every test case that a bug's neighbours vote for: ``bug_id, testcase_id, retrieval``, the score as a share of the bug's best.

    A bug's best score comes from an aggregation, so a long list is in no window.
    """
    votes = vote.vote_by_score(neighbours, links, k=None).select(
        F.col("query_id").alias("bug_id"), "testcase_id", F.col("aggregated_score").alias("score")
    )
    best = votes.groupBy("bug_id").agg(F.max("score").alias("best"))
    share = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)
    return votes.join(best, "bug_id").select("bug_id", "testcase_id", share.alias("retrieval"))
