"""Training pairs, hard negatives and pair features of the linked bugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.operators import dense, profile, vote
from rankjobs.plans import evaluate, training
from rankjobs.queries import model as m
from rankjobs.queries.retrieval import LINKED_SQL
from rankjobs.sources.artifacts import stage

_LANGUAGES, _STATES = ("en", "de", "es", "fr"), ("F", "O", "P")


def training_pairs(spark, sf):
    meta, corpus = m.history(spark, sf, words=False)
    return training.training_pairs(corpus.links, meta, m.testcases(spark, sf))


def _negatives(spark, sf):
    _, corpus = m.history(spark, sf, words=False)
    near = dense.dense_neighbours(corpus.vectors.withColumnRenamed("bug_id", "query_id"), corpus.vectors, 10)
    return training.hard_negatives(near.withColumnRenamed("dense_score", "hybrid_score"), corpus.links)


def hard_negatives(spark, sf):
    return _negatives(spark, sf)


def _bug_area():
    """Language, source and state as steps of a path."""
    return F.concat_ws("\\", F.split("bug_tags", "; ")[0], F.split("bug_tags", "; ")[1], "state")


def _testcase_area():
    case = F.col("testcase_id")
    language, state = (F.element_at(F.array(*map(F.lit, values)), (case % len(values) + 1).cast("int")) for values in (_LANGUAGES, _STATES))
    return F.concat_ws("\\", language, F.concat(F.lit("src"), (case % 20).cast("string")), state)


def _bug_tags():
    return F.split("bug_tags", "; ")


def _testcase_tags():
    return F.split(_testcase_area(), r"\\")


def area_levels(spark, sf):
    """Bugs and test cases of every area, and of all that it lies in."""
    return profile.area_overlap_levels(m.bugs(spark, sf), m.testcases(spark, sf), _bug_area(), _testcase_area())


def features_of(pairs, spark, sf):
    return training.pair_features(
        pairs,
        m.bugs(spark, sf),
        m.testcases(spark, sf),
        area=(_bug_area(), _testcase_area()),
        priority=(F.substring("priority", 1, 1), (F.col("testcase_id") % 5 + 1).cast("string")),
        tags=(_bug_tags(), _testcase_tags()),
        time=F.col("created").cast("date"),
    )


def pair_features(spark, sf):
    pairs = m.vote_links(spark, sf).select("bug_id", "testcase_id")
    out = features_of(pairs, spark, sf)
    return out.withColumns({"recency": F.round("recency", 9), "tag_overlap": F.round("tag_overlap", 9)})


def _ranked(spark, sf):
    """The candidates of all linked bugs, ranked with a model of linked pairs and hard negatives; and the links."""
    _, corpus = m.history(spark, sf, words=False)
    near = stage(
        dense.dense_neighbours(corpus.vectors.withColumnRenamed("bug_id", "query_id"), corpus.vectors, 10).withColumnRenamed(
            "dense_score", "hybrid_score"
        ),
        "neighbours",
    )
    own = corpus.links.select("bug_id", "testcase_id").distinct()
    wrong = training.hard_negatives(near, corpus.links).select("bug_id", "testcase_id")
    features = training.PATH_FEATURES
    model = training.fit_tree_ranker(features_of(own, spark, sf), features_of(wrong, spark, sf), features)
    pairs = features_of(training.candidates(near, corpus.links), spark, sf)
    return training.rank_pairs(stage(pairs, "candidates"), model, "retrieval", features=features), pairs, corpus.links


def learned_rank(spark, sf):
    ranked, _, _ = _ranked(spark, sf)
    scores = ("retrieval", "ranker_score", "final_score")
    return ranked.select("bug_id", "testcase_id", *(F.round(c, 9).alias(c) for c in scores), "rank")


def learned_rank_eval(spark, sf):
    """Hit rates of the candidates by their votes alone, and with the ranker."""
    ranked, pairs, links = _ranked(spark, sf)
    truth = links.select(F.col("bug_id").alias("query_id"), "testcase_id")
    asked = truth.select("query_id").distinct()
    plain = vote.ranked(pairs.withColumn("retrieval", F.round("retrieval", 9)), ("retrieval",), 10, ("bug_id",))
    out = None
    for method, lists in (("votes", plain), ("votes_and_trees", ranked)):
        found = evaluate.metrics_per_query(lists.withColumnRenamed("bug_id", "query_id"), truth, asked)
        means = evaluate.metric_means(found).select(F.lit(method).alias("method"), "*")
        out = means if out is None else out.unionByName(means)
    return out


_LIST = "[{}][testcase_id % {} + 1]"
_SQL_STEPS = f"""[{_LIST.format(str(list(_LANGUAGES))[1:-1], len(_LANGUAGES))}, 'src' || (testcase_id % 20),
    {_LIST.format(str(list(_STATES))[1:-1], len(_STATES))}]"""
_SQL_BUG_STEPS = "list_filter([split_part(bug_tags, '; ', 1), split_part(bug_tags, '; ', 2), state], lambda x: x IS NOT NULL AND x <> '')"

QUERIES = {
    "area_levels": (
        area_levels,
        m.with_ctes(
            ("bugs", "testcases"),
            {
                "paths": f"""SELECT {_SQL_BUG_STEPS} AS steps, 1 AS b, 0 AS t FROM bugs
                UNION ALL SELECT {_SQL_STEPS}, 0, 1 FROM testcases"""
            },
            """SELECT level, area, sum(b)::BIGINT AS bugs, sum(t)::BIGINT AS testcases FROM (
            SELECT level::INT AS level, array_to_string(steps[1:level], chr(92)) AS area, b, t
            FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS level FROM paths)) GROUP BY ALL""",
        ),
    ),
    "learned_rank": (learned_rank, None),
    "learned_rank_eval": (learned_rank_eval, None),
    "training_pairs": (
        training_pairs,
        m.with_ctes(
            ("metadata", "vote_links"),
            {},
            """SELECT DISTINCT l.bug_id, l.testcase_id, bug_text_enriched AS bug_text, testcase_title AS testcase_text
            FROM vote_links l JOIN metadata USING (bug_id)""",
        ),
    ),
    "hard_negatives": (
        hard_negatives,
        m.with_ctes(
            ("metadata", "vote_links"),
            {
                **LINKED_SQL,
                **m.sql_dense("near", "cv", "cv", 10),
                "others": m.sql_without_self("near", 10),
                "lists": "SELECT query_id, bug_id, dense_score AS hybrid_score FROM others",
                "sums": m.sql_vote_score("v", "lists", "vote_links")["v_sums"],
            },
            """SELECT query_id AS bug_id, testcase_id, aggregated_score AS score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY aggregated_score DESC, supporting_bug_count DESC, testcase_id) AS rank
            FROM sums s WHERE NOT EXISTS (SELECT 1 FROM vote_links l WHERE l.bug_id = s.query_id AND l.testcase_id = s.testcase_id))
            WHERE rank <= 5""",
        ),
    ),
    "pair_features": (
        pair_features,
        m.with_ctes(
            ("bugs", "testcases", "vote_links"),
            {
                "cases": f"SELECT testcase_id, {_SQL_STEPS} AS steps FROM testcases",
                "sides": f"""SELECT l.bug_id, l.testcase_id, {_SQL_BUG_STEPS} AS own, t.steps AS other,
                substr(priority, 1, 1) = (l.testcase_id % 5 + 1)::VARCHAR AS p,
                list_distinct([split_part(bug_tags, '; ', 1), split_part(bug_tags, '; ', 2)]) AS x, list_distinct(t.steps) AS y,
                date_diff('day', created::DATE, (SELECT max(created::DATE) FROM bugs)) AS age
                FROM (SELECT DISTINCT bug_id, testcase_id FROM vote_links) l JOIN bugs USING (bug_id) JOIN cases t USING (testcase_id)"""
            },
            """SELECT bug_id, testcase_id, (own = other)::INT AS area_match,
            len(list_filter([1, 2, 3], lambda n: n <= least(len(own), len(other)) AND own[1:n] = other[1:n]))::INT AS area_depth, coalesce(p::INT, 0) AS priority_match,
            round(CASE WHEN len(list_concat(x, y)) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0 END, 9) AS tag_overlap,
            round(coalesce(pow(0.5, age / 365.0), 0), 9) AS recency FROM sides""",
        ),
    ),
}
