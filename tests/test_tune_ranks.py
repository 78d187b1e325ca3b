"""The grid places the first true item without a ranking per configuration."""

from __future__ import annotations

from rankjobs.operators import embed, rerank, vote
from rankjobs.plans import tune


def test_grid_ranks_no_list_per_configuration(spark, monkeypatch):
    bugs = spark.createDataFrame(
        [(i, f"title {i % 5}", f"text {'abc'[i % 3]} {i}", "t", "1") for i in range(20)],
        "bug_id bigint, bug_title string, bug_description string, bug_tags string, severity string",
    )
    links = spark.createDataFrame(
        [(i, (i * k) % 9, f"title {(i * k) % 9}") for i in range(20) for k in (1, 3)],
        "bug_id bigint, testcase_id bigint, testcase_title string",
    ).distinct()

    def vectorize(df, id_column, text_column, as_query):
        return embed.token_hash_vectors(df, id_column, text_column, dim=32, as_query=as_query)

    def no_ranking(*_, **__):
        raise AssertionError("a list is sorted for each configuration")

    monkeypatch.setattr(tune.vote, "ranked", no_ranking)
    grid = tune.Grid(top_ks=(2, 4), weights=tune.WEIGHTS[::2], rerank_weights=(0.25, 0.75))
    out = tune.evaluate_grid(bugs, links, vectorize, rerank.token_overlap_scorer, grid).collect()
    assert len(out) == 2 * 2 * 2 * 2 * 7
    monkeypatch.undo()
    # one configuration by its own slow way: dense lists, ballots, one vote, one ranking
    asked = tune.variant_lists(bugs, tune.Grid(top_ks=(4,), sets=tune.EXPERIMENT_SETS[:1]), tune.EXPERIMENT_SETS[0], vectorize)
    voted = vote.vote_by_ballot(asked.withColumnRenamed("position", "hybrid_rank"), links, weights=tune.WEIGHTS[0], k=10).collect()
    true = {(r.bug_id, r.testcase_id) for r in links.collect()}
    first = {}
    for r in voted:
        if (r.query_id, r.testcase_id) in true:
            first[r.query_id] = min(first.get(r.query_id, 99), r["rank"])
    mrr = round(sum(1 / r for r in first.values()) / 20, 9)
    got = {r.mrr for r in out if r.experiment_set == "dense_only" and r.top_k_dense == 4 and r.aggregation_weights.similarity == 0.7}
    assert got == {mrr}
