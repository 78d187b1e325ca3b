"""The configuration grid."""

from __future__ import annotations


from rankjobs.operators import embed, rerank, vote
from rankjobs.plans import tune


def test_grid_order_and_names(spark):
    grid = tune.experiment_grid(spark).orderBy("n").collect()
    assert [r.n for r in grid] == list(range(1, 568))
    assert len({tuple(map(str, r)) for r in grid}) == 567
    assert grid[0].experiment_name == "dense_only_dense10_bm2510_agg0.7-0.2-0.1_rw0.25"
    assert grid[7].experiment_set == "dense_only" and grid[7].reranker_weight == 0.5
    assert grid[-1].experiment_name == "dense_bm25_reranker_metadata_dense50_bm2550_agg0.5-0.3-0.2_rw0.75"


def judged(spark, scores, max_stale=8):
    rows = [(n, *s) for n, s in enumerate(scores, 1)]
    results = spark.createDataFrame(rows, "n int, `hit@1` double, `hit@5` double, mrr double")
    return tune.improvements(results, max_stale)


def test_best_keeps_the_earlier_of_equals(spark):
    out = judged(spark, [(0.1, 0.2, 0.3), (0.1, 0.2, 0.3), (0.1, 0.3, 0.1), (0.1, 0.3, 0.1), (0.05, 0.9, 0.9)])
    assert [r.improved for r in out.orderBy("n").collect()] == [True, False, True, False, False]
    assert tune.best_config(out).first().n == 3
    assert [r.n for r in tune.leaderboard(out, 3).collect()] == [3, 4, 1]


def test_early_stop(spark):
    out = judged(spark, [(0.5, 0.0, 0.0)] + [(0.1, 0.0, 0.0)] * 3 + [(0.9, 0.0, 0.0)], max_stale=3)
    assert [r.status for r in out.orderBy("n").collect()] == ["completed"] * 4 + ["skipped"]
    assert tune.best_config(out).first().n == 1
    assert tuple(tune.run_summary(out).first()) == (4, 1)
    late = judged(spark, [(0.5, 0.0, 0.0)] + [(0.1, 0.0, 0.0)] * 2 + [(0.9, 0.0, 0.0)], max_stale=3)
    assert {r.status for r in late.collect()} == {"completed"}


def test_ineffective_parameters_share_results(spark):
    bugs = spark.createDataFrame(
        [(i, f"title {i % 3}", f"text {'ab'[i % 2]} {i}", "t", "1") for i in range(12)],
        "bug_id bigint, bug_title string, bug_description string, bug_tags string, severity string",
    )
    links = spark.createDataFrame(
        [(i, i % 3, f"title {i % 3}") for i in range(12)], "bug_id bigint, testcase_id bigint, testcase_title string"
    )

    def vectorize(df, id_column, text_column, as_query):
        return embed.token_hash_vectors(df, id_column, text_column, dim=32, as_query=as_query)

    grid = tune.Grid(top_ks=(2, 4), weights=(vote.VoteWeights(),), rerank_weights=(0.25, 0.75), sets=tune.EXPERIMENT_SETS[:2])
    out = tune.evaluate_grid(bugs, links, vectorize, rerank.token_overlap_scorer, grid).orderBy("n").collect()
    assert len(out) == 2 * 2 * 2 * 2
    plain = {r.top_k_dense: set() for r in out}
    for r in out:
        if not r.use_reranker:
            plain[r.top_k_dense].add((r["hit@1"], r["hit@5"], r.mrr))
        assert r["hit@1"] <= r["hit@3"] <= r["hit@5"] <= r["hit@10"] and r.mrr >= r["hit@1"]
    assert all(len(v) == 1 for v in plain.values())


def test_variant_texts(spark):
    row = spark.createDataFrame([("TC1 Ab", "t", "s", "d")], "bug_title string, bug_tags string, severity string, bug_description string")
    texts = {s.name: row.select(tune.variant_text(s).alias("t")).first().t for s in tune.EXPERIMENT_SETS}
    assert texts["dense_only"].startswith("Normalized Title: tc1 ab\n") and "[SEV" not in texts["dense_only"]
    assert texts["dense_normalized_titles"].startswith("Normalized Title: tc ab\n")
    assert texts["dense_metadata_tokens"].endswith("[SEV_S] [TAG_T]")
