"""Votes, reranking, metrics, diagnosis."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rankjobs.operators import rerank, vote
from rankjobs.plans import diagnose, evaluate

NEAR = "query_id bigint, bug_id bigint, hybrid_score double, hybrid_rank int"
LINKS = "bug_id bigint, testcase_id bigint, testcase_title string"


@pytest.fixture()
def neighbours(spark):
    return spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2), (2, 11, 0.4, 1)], NEAR)


@pytest.fixture()
def links(spark):
    return spark.createDataFrame(
        [(10, 100, "x"), (10, 101, "y"), (11, 100, "x"), (11, 102, None), (11, 103, "z"), (12, 104, "w")], LINKS
    )


def ids(df, query=1):
    return [r.testcase_id for r in df.filter(F.col("query_id") == query).orderBy("rank").collect()]


def test_vote_by_position(neighbours, links):
    out = vote.vote_by_position(neighbours, links)
    assert ids(out) == [100, 101, 103]
    row = out.filter("query_id = 1 and testcase_id = 100").first()
    assert row.similarity_sum == 1.4 and row.support_count == 2 and row.rank_bonus == 1.5
    assert row.final_score == pytest.approx(0.7 * 1.4 + 0.2 * 2 + 0.1 * 1.5)
    assert ids(vote.vote_by_position(neighbours, links, 1)) == [100]


def test_repeated_links_vote_again_only_by_position(neighbours, links):
    twice = links.union(links.filter("bug_id = 10"))
    by_position = vote.vote_by_position(neighbours, twice).filter("query_id = 1 and testcase_id = 101").first()
    assert (by_position.similarity_sum, by_position.support_count, by_position.rank_bonus) == (1.8, 1, 2.0)
    by_score = vote.vote_by_score(neighbours, twice).filter("query_id = 1 and testcase_id = 101").first()
    assert (by_score.aggregated_score, by_score.supporting_bug_count) == (0.9, 1)


def test_vote_by_ballot_ranks_joined_rows(neighbours, links):
    out = {r.testcase_id: r for r in vote.vote_by_ballot(neighbours, links).filter("query_id = 1").collect()}
    # ballots in order: (10,100) (10,101) (11,100) (11,102 without title) (11,103)
    assert out[100].rank_bonus == pytest.approx(1 + 1 / 3) and out[101].rank_bonus == 0.5 and out[103].rank_bonus == 0.2
    assert 102 not in out


def test_ranked_links_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(vote, "IDS_PER_RANGE", 3)
    ids = [1, 2, 5, 6, 7, 20, 21]
    links = spark.createDataFrame([(b, t, "t") for b in (1, 2) for t in ids[b - 1 :]] * 2, LINKS)
    rows = sorted(tuple(r) for r in vote.ranked_links(links).select("bug_id", "testcase_id", "link_rank", "link_count").collect())
    assert rows == [(b, t, i, len(ids) - b + 1) for b in (1, 2) for i, t in enumerate(ids[b - 1 :], 1)]


def test_votes_tie_by_id(spark):
    near = spark.createDataFrame([(1, 10, 0.5, 1)], NEAR)
    links = spark.createDataFrame([(10, t, "t") for t in (5, 3, 4)], LINKS)
    assert ids(vote.vote_by_score(near, links)) == [3, 4, 5]


def test_link_weights(spark, neighbours):
    links = spark.createDataFrame([(10, 100, "x", 1.0), (11, 101, "y", 3.0)], f"{LINKS}, link_weight double")
    assert ids(vote.vote_by_link_weight(neighbours, links)) == [101, 100]


@pytest.fixture()
def retrieved(neighbours, links):
    return vote.vote_by_score(neighbours, links)


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, "about y and z"), (2, "q")], "query_id bigint, query_text string")


def test_rerank_after_cut(retrieved, queries):
    out = rerank.rerank_after_cut(retrieved, queries, rerank.token_overlap_scorer)
    assert set(ids(out)) == {100, 101, 103} and ids(out)[0] == 101
    row = out.filter("query_id = 1 and testcase_id = 101").first()
    assert row.reranker_score == pytest.approx(1 / (1 + math.exp(-0.25)))
    assert row.ranking_method == "reranked"
    plain = rerank.rerank_after_cut(retrieved, queries, None)
    assert ids(plain) == ids(retrieved) and plain.first().reranker_score is None


def test_rerank_before_cut(neighbours, links, queries):
    candidates = vote.vote_by_ballot(neighbours, links)
    assert ids(rerank.rerank_before_cut(candidates, queries, None, 0.5, 2)) == ids(candidates)[:2]
    zero = rerank.rerank_before_cut(candidates, queries, rerank.token_overlap_scorer, 0.0, 3)
    assert ids(zero) == ids(candidates)
    full = rerank.rerank_before_cut(candidates, queries, rerank.token_overlap_scorer, 1.0, 3)
    assert ids(full) == [101, 103, 100]


def test_python_and_stored_scorers(spark, retrieved, queries):
    make = lambda: lambda pairs: [float("z" in title) for _, title in pairs]
    out = rerank.rerank_after_cut(retrieved, queries, rerank.python_scorer(make, batch_size=1))
    # 100 and 103 tie at one half, the smaller id comes first
    assert ids(out) == [100, 103, 101]
    stored = spark.createDataFrame([(1, 100, 0.1), (1, 101, 0.2), (1, 103, 9.0)], "query_id bigint, testcase_id bigint, raw_score double")
    again = rerank.rerank_after_cut(retrieved, queries, rerank.stored_scorer(stored))
    assert again.filter("query_id = 1").count() == 3


def test_failing_scorer_fails_the_job(retrieved, queries):
    def make():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        rerank.rerank_after_cut(retrieved, queries, rerank.python_scorer(make)).collect()


def test_metrics(spark):
    predicted = spark.createDataFrame([(1, 5, 1), (1, 6, 4), (2, 5, 1)], "query_id bigint, testcase_id bigint, rank int")
    truth = spark.createDataFrame([(1, 6), (1, 99), (2, 8)], "query_id bigint, testcase_id bigint")
    asked = truth.select("query_id").distinct()
    rows = {r.query_id: r for r in evaluate.metrics_per_query(predicted, truth, asked).collect()}
    assert tuple(rows[1])[1:] == (0, 0, 1, 1, 0.25)
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, 0.0)
    mean = evaluate.metric_means(evaluate.metrics_per_query(predicted, truth, asked)).first()
    assert mean["queries"] == 2 and mean["hit@5"] == 0.5 and mean["mrr"] == 0.125


def test_evaluated_queries_need_metadata(spark):
    truth = spark.createDataFrame([(1, 6), (2, None), (3, 7)], "query_id bigint, testcase_id bigint")
    meta = spark.createDataFrame([(1,), (2,)], "bug_id bigint")
    assert [r.query_id for r in evaluate.evaluated_queries(meta, truth).collect()] == [1]


def test_time_split(spark):
    rows = spark.createDataFrame([(i, f"2020-01-{i:02d}") for i in range(1, 11)], "id bigint, day string")
    before, after = evaluate.time_split(rows, "day", "2020-01-04")
    assert (before.count(), after.count()) == (3, 7)
    before, after = evaluate.time_split(rows, "day", share=0.5)
    assert before.count() + after.count() == 10 and before.count() in (4, 5)


RESULTS = "bug_id bigint, ground_truth_testcases array<bigint>, predicted_testcases array<bigint>, `hit@10` int"


def test_diagnosis(spark):
    results = spark.createDataFrame(
        [(1, [5, 6], [7], 0), (2, [5], [5], 1), (3, [5], [8, 7], 0), (4, [9], [], 0)], RESULTS
    )
    bugs = spark.createDataFrame(
        [(1, "Login error", None, "1"), (3, "login fails", "text", None), (4, None, " ", None)],
        "bug_id bigint, bug_title string, bug_description string, severity string",
    )
    failed = diagnose.failures(results)
    assert tuple(diagnose.failure_rate(results).first()) == (4, 3, 75.0)
    assert [tuple(r) for r in diagnose.id_counts(failed, "ground_truth_testcases").collect()] == [(5, 2), (6, 1), (9, 1)]
    assert {r.cause for r in diagnose.likely_causes(failed, bugs).collect()} == {
        diagnose.CAUSE_SPARSE,
        diagnose.CAUSE_GENERIC,
        diagnose.CAUSE_MISS,
    }
    causes = {r.bug_id: r.causes for r in diagnose.row_causes(failed).collect()}
    assert len(causes[1]) == 2 and causes[3] == [diagnose.ROW_CAUSE_MISS]
    again = diagnose.recomputed_hits(results)
    assert [r["computed_hit@10"] for r in again.orderBy("bug_id").collect()] == [0, 1, 0, 0]
    text = results.withColumns({c: F.to_json(c) for c in ("ground_truth_testcases", "predicted_testcases")})
    assert [r["computed_hit@10"] for r in diagnose.recomputed_hits(text).orderBy("bug_id").collect()] == [0, 1, 0, 0]
    assert tuple(diagnose.several_truths_share(failed).first()) == (1, 33.33)
    sections = {r.section for r in diagnose.failure_report(results, bugs).collect()}
    assert sections == {"overview", "failed_truth", "failed_prediction", "severity", "title_token", "cause", "example"}


def test_diagnosis_without_failures(spark):
    results = spark.createDataFrame([(1, [5], [5], 1)], RESULTS)
    bugs = spark.createDataFrame([(1, "a", "b", "c")], "bug_id bigint, bug_title string, bug_description string, severity string")
    failed = diagnose.failures(results)
    assert [r.cause for r in diagnose.likely_causes(failed, bugs).collect()] == [diagnose.CAUSE_MISS]
    assert tuple(diagnose.several_truths_share(failed).first()) == (0, 0.0)


def test_coverage(spark):
    results = spark.createDataFrame([(1, [5], [], 0), (2, [6], [6], 1)], RESULTS)
    links = spark.createDataFrame([(1, 5), (2, 6), (3, 6)], "bug_id bigint, testcase_id bigint")
    rows = {r.coverage: (r.bugs, r.failed) for r in diagnose.coverage_slices(results, links).collect()}
    assert rows == {"cold": (1, 1), "sparse": (1, 0)}
