"""Evaluation, diagnosis and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.operators import dense, embed, rerank, vote
from rankjobs.plans import diagnose, evaluate, tune
from rankjobs.queries import model as m
from rankjobs.queries.ranking import rerank_eval_sql
from rankjobs.queries.retrieval import LINKED_SQL
from rankjobs.sources.artifacts import stage


def label_eval(spark, sf):
    """Nearest vectors vote for labels: per-query metrics, the smallest end-to-end slice."""
    vectors = stage(m.vectors(spark, sf), "vectors")
    links = m.label_links(spark, sf)
    near = dense.dense_neighbours(
        vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "bug_id"), 10
    )
    lists = vote.vote_by_score(near, links, 10, score="dense_score")
    truth = links.select(F.col("bug_id").alias("query_id"), "testcase_id")
    asked = evaluate.evaluated_queries(vectors.withColumnRenamed("vec_id", "bug_id"), truth)
    out = evaluate.metrics_per_query(lists, truth, asked)
    return out.withColumn("mrr", F.round("mrr", 9))


def _leave_one_out(spark, sf):
    meta, corpus = m.history(spark, sf)
    queries = meta.select(F.col("bug_id").alias("query_id"), F.col("bug_text_enriched").alias("query_text"))
    lists = stage(
        evaluate.leave_one_out_lists(meta, stage(m.vectorize_queries(queries), "query-vectors"), corpus, rerank.token_overlap_scorer),
        "lists",
    )
    truth = corpus.links.select(F.col("bug_id").alias("query_id"), "testcase_id")
    return meta, corpus, lists, truth, evaluate.evaluated_queries(meta, truth)


def eval_as_of(spark, sf):
    """Every linked bug asks the bugs before it: per-query metrics."""
    meta, corpus = m.history(spark, sf, words=False)
    vectors = corpus.vectors.withColumnRenamed("bug_id", "query_id")
    lists = evaluate.as_of_lists(vectors, corpus, meta.select("bug_id", F.col("created").alias("time")))
    truth = corpus.links.select(F.col("bug_id").alias("query_id"), "testcase_id")
    out = evaluate.metrics_per_query(lists, truth, evaluate.evaluated_queries(meta, truth))
    return out.withColumn("mrr", F.round("mrr", 9))


def eval_metrics(spark, sf):
    _, _, lists, truth, asked = _leave_one_out(spark, sf)
    out = evaluate.evaluate(lists, truth, asked)
    return out.withColumn("mrr", F.round("mrr", 9))


def eval_summary(spark, sf):
    _, _, lists, truth, asked = _leave_one_out(spark, sf)
    out = evaluate.summary(evaluate.evaluate(lists, truth, asked))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 9) for c in out.columns if c not in ("method", "queries")})


def _per_bug(spark, sf, use_reranker=True):
    meta, corpus, lists, truth, asked = _leave_one_out(spark, sf)
    return meta, corpus, stage(evaluate.per_bug_table(lists, truth, asked, use_reranker), "per-bug")


def _listed(name, decimals=None):
    values = F.transform(name, lambda x: F.round(x, decimals)) if decimals else F.col(name)
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",").alias(name)


_ID_LISTS = (
    "ground_truth_testcases", "baseline_predicted_testcases", "dense_reranked_predicted_testcases", "hybrid_predicted_testcases",
    "hybrid_reranked_predicted_testcases", "predicted_testcases",
)


def eval_per_bug(spark, sf):
    _, _, table = _per_bug(spark, sf)
    score = [
        F.array_join(F.transform(c, lambda x: F.round(x * 1e5).cast("bigint").cast("string")), ",").alias(c)
        for c in ("retrieval_scores", "reranker_scores", "final_scores")
    ]
    return table.select(
        "bug_id", *map(_listed, _ID_LISTS), *(f"hit@{k}" for k in evaluate.CUTOFFS), F.round("mrr", 9).alias("mrr"), "ranking_method", *score
    )


def failures_summary(spark, sf):
    meta, _, table = _per_bug(spark, sf)
    failed = diagnose.failures(table)
    described = failed.select("bug_id").join(meta, "bug_id", "left")
    rate, several = diagnose.failure_rate(table), diagnose.several_truths_share(failed)
    blank = diagnose.blank_description_share(described)

    def rows(df):
        cells = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))
        return df.select(F.explode(cells).alias("c")).select("c.*")

    recomputed = diagnose.recomputed_hits(table).agg(F.sum(1 - F.col("computed_hit@10")).alias("failed_recomputed"))
    return rows(rate).unionByName(rows(several)).unionByName(rows(blank)).unionByName(rows(recomputed))


def failed_ids(spark, sf):
    _, _, table = _per_bug(spark, sf)
    failed = diagnose.failures(table)
    expected = diagnose.id_counts(failed, "ground_truth_testcases").withColumn("kind", F.lit("truth"))
    return expected.unionByName(diagnose.id_counts(failed, "predicted_testcases").withColumn("kind", F.lit("predicted")))


def failure_causes(spark, sf):
    meta, _, table = _per_bug(spark, sf)
    failed = diagnose.failures(table)
    described = failed.select("bug_id").join(meta, "bug_id", "left")
    causes = diagnose.likely_causes(failed, meta).select("cause", F.col("score").cast("bigint").alias("n"))
    severity = diagnose.severity_distribution(described).select(F.concat(F.lit("severity "), "severity").alias("cause"), "n")
    rows = diagnose.row_causes(failed).select(F.explode("causes").alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    return causes.unionByName(severity).unionByName(rows)


def coverage_slices(spark, sf):
    _, corpus, table = _per_bug(spark, sf)
    return diagnose.coverage_slices(table, corpus.links)


def failure_report(spark, sf):
    meta, _, table = _per_bug(spark, sf)
    return diagnose.failure_report(table, meta)


def _vectorize(df, id_column, text_column, as_query):
    return embed.token_hash_vectors(df, id_column, text_column, dim=m.VECTOR_DIM, as_query=as_query)


GRID = tune.Grid()


def _grid(spark, sf):
    links = stage(m.vote_links(spark, sf), "links")
    bugs = stage(m.linked_bugs(spark, sf, links), "bugs")
    return tune.improvements(stage(tune.evaluate_grid(bugs, links, _vectorize, grid=GRID), "grid"))


def _grid_columns(df):
    names = [f"hit@{k}" for k in evaluate.CUTOFFS] + ["mrr"]
    return df.select("n", "experiment_name", *(F.round(F.col(f"`{c}`"), 9).alias(c) for c in names), "improved", "status")


def grid_results(spark, sf):
    return _grid_columns(_grid(spark, sf))


def grid_leaderboard(spark, sf):
    return _grid_columns(tune.leaderboard(_grid(spark, sf), 10))


def grid_best(spark, sf):
    return _grid_columns(tune.best_config(_grid(spark, sf)))


_BOTH = {
    **LINKED_SQL,
    "prefixed": f"SELECT id, 'query: ' || {m.sql_strip('text')} AS text FROM corpus",
    **m.sql_hash_vectors("qv", "prefixed"),
    **m.sql_dense("near", "qv", "cv", 50),
    "others": m.sql_without_self("near", 50),
    "shallow": m.sql_without_self("near", 10),
    **m.sql_bm25("words", "c", "corpus", 50, True),
    **m.sql_rrf("fused", "others", "words", 50),
    "base": "SELECT query_id, bug_id, dense_score AS hybrid_score FROM shallow",
    **m.sql_vote_score("vb", "base", "vote_links"),
    **m.sql_vote_score("vh", "fused", "vote_links"),
    "voted": "SELECT 'baseline' AS method, * FROM vb UNION ALL SELECT 'hybrid', * FROM vh",
    **rerank_eval_sql("voted", "corpus", "method, query_id"),
    "lists": f"""SELECT method, query_id, testcase_id, rank, aggregated_score, NULL::DOUBLE AS reranker_score, NULL::DOUBLE AS final_score FROM voted
        UNION ALL SELECT CASE method WHEN 'baseline' THEN 'reranked' ELSE 'hybrid_reranked' END, query_id, testcase_id, rank,
        aggregated_score, reranker_score, final_score FROM reranked""",
    "methods": "SELECT unnest(['baseline', 'reranked', 'hybrid', 'hybrid_reranked']) AS method",
    "hits": """SELECT l.method, l.query_id, min(l.rank) AS r FROM lists l JOIN vote_links t ON t.bug_id = l.query_id AND t.testcase_id = l.testcase_id
        GROUP BY ALL""",
    "metrics": """SELECT m.method, q.id AS query_id, coalesce((r <= 1)::INT, 0) AS "hit@1", coalesce((r <= 3)::INT, 0) AS "hit@3",
        coalesce((r <= 5)::INT, 0) AS "hit@5", coalesce((r <= 10)::INT, 0) AS "hit@10", coalesce(1.0::DOUBLE / r, 0) AS mrr
        FROM corpus q CROSS JOIN methods m LEFT JOIN hits h ON h.method = m.method AND h.query_id = q.id""",
}


def _score_sql(value: str, name: str) -> str:
    units = f"round({value} * 1e5)::BIGINT::VARCHAR"
    return f"coalesce(string_agg({units}, ',' ORDER BY rank) FILTER (method = 'hybrid_reranked'), '') AS {name}"


def _list_sql(method: str, name: str) -> str:
    return f"coalesce(string_agg(testcase_id::VARCHAR, ',' ORDER BY rank) FILTER (method = '{method}'), '') AS {name}"


_TABLE = {
    **_BOTH,
    "expected": "SELECT bug_id AS query_id, list_sort(list(DISTINCT testcase_id)) AS ids FROM vote_links GROUP BY bug_id",
    "predictions": f"""SELECT query_id, {_list_sql('baseline', 'baseline_predicted_testcases')}, {_list_sql('reranked', 'dense_reranked_predicted_testcases')},
        {_list_sql('hybrid', 'hybrid_predicted_testcases')}, {_list_sql('hybrid_reranked', 'hybrid_reranked_predicted_testcases')},
        {_score_sql('aggregated_score', 'retrieval_scores')}, {_score_sql('reranker_score', 'reranker_scores')}, {_score_sql('final_score', 'final_scores')}
        FROM lists GROUP BY query_id""",
    "failed": "SELECT query_id FROM metrics WHERE method = 'hybrid_reranked' AND \"hit@10\" = 0",
    "described": "SELECT b.* FROM metadata b JOIN failed f ON f.query_id = b.bug_id",
    "truths": "SELECT f.query_id, len(e.ids) AS n, e.ids FROM failed f JOIN expected e USING (query_id)",
    "truth_counts": """SELECT testcase_id, count(*) AS n FROM (SELECT unnest(ids) AS testcase_id FROM truths) GROUP BY 1
        ORDER BY n DESC, testcase_id LIMIT 10""",
    "title_tokens": r"""SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(coalesce(bug_title, ''), '[\p{L}\p{N}_]+'))) AS token FROM described)
        WHERE length(token) > 2 GROUP BY 1 ORDER BY n DESC, token LIMIT 10""",
}


def _grid_sql() -> dict[str, str]:
    """All configurations of ``GRID`` in SQL, variant by variant."""
    ctes: dict[str, str] = {}
    hits = []
    weights = " UNION ALL ".join(
        f"SELECT {i} AS w, {w.similarity}::DOUBLE AS ws, {w.support}::DOUBLE AS wn, {w.rank}::DOUBLE AS wr" for i, w in enumerate(GRID.weights)
    )
    ctes["weights"] = weights
    ctes["depths"] = f"SELECT unnest([{', '.join(map(str, GRID.top_ks))}]) AS k"
    ctes["rws"] = f"SELECT unnest([{', '.join(map(str, GRID.rerank_weights))}])::DOUBLE AS rw"
    deepest = max(GRID.top_ks)
    for s in {x.variant: x for x in GRID.sets}.values():
        p = {"original": "o", "original+tokens": "t", "normalized": "z"}[s.variant]
        members = [x for x in GRID.sets if x.variant == s.variant]
        text = m.sql_enriched(*m.BUG_FIELDS_SQL, "b", s.normalized_titles, s.metadata_tokens)
        ctes |= {
            f"{p}_texts": f"SELECT bug_id AS id, {text} AS text FROM bugs WHERE bug_id IN (SELECT bug_id FROM vote_links)",
            f"{p}_prefixed": f"SELECT id, 'query: ' || {m.sql_strip('text')} AS text FROM {p}_texts",
            **m.sql_hash_vectors(f"{p}_cv", f"{p}_texts"),
            **m.sql_hash_vectors(f"{p}_qv", f"{p}_prefixed"),
            **m.sql_dense(f"{p}_near", f"{p}_qv", f"{p}_cv", deepest),
            f"{p}_others": m.sql_without_self(f"{p}_near", deepest),
            f"{p}_cut": f"SELECT k AS kd, o.* FROM {p}_others o JOIN depths ON raw_rank <= k",
        }
        lists = []
        if any(not x.bm25 for x in members):
            lists.append(f"SELECT false AS b, kd, 0 AS kb, query_id, bug_id, dense_score AS score, dense_rank AS pos FROM {p}_cut")
        if any(x.bm25 for x in members):
            ctes |= {
                **m.sql_bm25_stats(f"{p}_c", f"{p}_texts"),
                **m.sql_bm25(f"{p}_words", f"{p}_c", f"{p}_texts", deepest, True),
                f"{p}_d": f"SELECT kd, k AS kb, c.* EXCLUDE (kd) FROM {p}_cut c, depths",
                f"{p}_b": f"SELECT d.k AS kd, b.k AS kb, w.* FROM {p}_words w JOIN depths b ON w.bm25_rank <= b.k, depths d",
                f"{p}_all": f"""SELECT coalesce(d.kd, b.kd) AS kd, coalesce(d.kb, b.kb) AS kb, coalesce(d.query_id, b.query_id) AS query_id,
                    coalesce(d.bug_id, b.bug_id) AS bug_id, dense_score, bm25_score, 1.0::DOUBLE / (60 + coalesce(dense_rank, 1000000000))
                    + 1.0::DOUBLE / (60 + coalesce(bm25_rank, 1000000000)) AS score FROM {p}_d d FULL OUTER JOIN {p}_b b
                    ON b.kd = d.kd AND b.kb = d.kb AND b.query_id = d.query_id AND b.bug_id = d.bug_id""",
                f"{p}_kept": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kd, kb, query_id ORDER BY score DESC,
                    dense_score DESC NULLS LAST, bm25_score DESC NULLS LAST, bug_id) AS r FROM {p}_all) WHERE r <= greatest(kd, kb)""",
            }
            lists.append(
                f"""SELECT true AS b, kd, kb, query_id, bug_id, score, row_number() OVER (PARTITION BY kd, kb, query_id
                ORDER BY score DESC, dense_score DESC NULLS LAST, bug_id) AS pos FROM {p}_kept"""
            )
        variants = []
        for with_bm25 in (False, True):
            if any(x.bm25 == with_bm25 and not x.reranker for x in members):
                variants.append(f"SELECT {str(with_bm25).lower()} AS b, 0.0::DOUBLE AS rw")
            if any(x.bm25 == with_bm25 and x.reranker for x in members):
                variants.append(f"SELECT {str(with_bm25).lower()}, rw FROM rws")
        words = r"list_distinct(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t)))"
        by = "b, kd, kb, query_id"

        def scaled(x: str, keys: str) -> str:
            lo, hi = f"min({x}) OVER (PARTITION BY {keys})", f"max({x}) OVER (PARTITION BY {keys})"
            return f"CASE WHEN {hi} > {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE 1.0 END"

        ctes |= {
            f"{p}_lists": " UNION ALL ".join(lists),
            f"{p}_variants": " UNION ALL ".join(variants),
            f"{p}_ballots": f"""SELECT {by}, n.bug_id, score, testcase_id, testcase_title, row_number() OVER (PARTITION BY {by}
                ORDER BY pos, testcase_id) AS ord FROM {p}_lists n JOIN vote_links l ON l.bug_id = n.bug_id""",
            f"{p}_sums": f"""SELECT {by}, testcase_id, testcase_title, round(sum(score), 9) AS ss, count(*) AS sn,
                round(sum(1.0::DOUBLE / ord), 9) AS sr FROM {p}_ballots GROUP BY ALL""",
            f"{p}_qw": f"SELECT id, {words.format('text')} AS qw FROM {p}_texts",
            f"{p}_pairs": f"""SELECT query_id, testcase_id, len(list_intersect(qw, tw))::DOUBLE / len(list_distinct(list_concat(qw, tw))) AS raw
                FROM (SELECT DISTINCT query_id, testcase_id, {words.format('testcase_title')} AS tw FROM {p}_sums) JOIN {p}_qw ON id = query_id""",
            f"{p}_scored": f"SELECT s.*, {scaled('raw', by)} AS rn FROM {p}_sums s JOIN {p}_pairs USING (query_id, testcase_id)",
            f"{p}_w": f"SELECT s.*, w, round(ws * ss + wn * sn + wr * sr, 12) AS fs FROM {p}_scored s, weights",
            f"{p}_n": f"SELECT *, {scaled('fs', by + ', w')} AS rs FROM {p}_w",
            f"{p}_f": f"""SELECT n.*, rw, CASE WHEN rw > 0 THEN round((1 - rw) * rs + rw * rn, 9) ELSE fs END AS score,
                CASE WHEN rw > 0 THEN 0 ELSE ss END AS s2, CASE WHEN rw > 0 THEN 0 ELSE sn END AS s3 FROM {p}_n n JOIN {p}_variants v ON v.b = n.b""",
            f"{p}_ranked": f"""SELECT *, row_number() OVER (PARTITION BY {by}, w, rw ORDER BY score DESC, s2 DESC, s3 DESC, testcase_id) AS rank FROM {p}_f""",
            f"{p}_hits": f"""SELECT '{s.variant}' AS variant, b, kd, kb, w, rw, query_id, min(rank) AS r FROM {p}_ranked JOIN vote_links t
                ON t.bug_id = query_id AND t.testcase_id = {p}_ranked.testcase_id WHERE rank <= 10 GROUP BY ALL""",
        }
        hits.append(f"SELECT * FROM {p}_hits")
    ctes["all_hits"] = " UNION ALL ".join(hits)
    sums = ", ".join(f'round(sum((r <= {k})::INT) / (SELECT count(DISTINCT bug_id) FROM vote_links), 9) AS "hit@{k}"' for k in evaluate.CUTOFFS)
    ctes["means"] = f"""SELECT variant, b, kd, kb, w, rw, {sums}, round(sum(1.0::DOUBLE / r) / (SELECT count(DISTINCT bug_id) FROM vote_links), 9)
        AS mrr FROM all_hits GROUP BY ALL"""
    rows = []
    n = 0
    for kd in GRID.top_ks:
        for kb in GRID.top_ks:
            for wi, w in enumerate(GRID.weights):
                for rw in GRID.rerank_weights:
                    for s in GRID.sets:
                        n += 1
                        name = f"{s.name}_dense{kd}_bm25{kb}_agg{w.similarity:.1f}-{w.support:.1f}-{w.rank:.1f}_rw{rw:.2f}"
                        rows.append(
                            f"({n}, '{name}', '{s.variant}', {str(s.bm25).lower()}, {kd}, {kb if s.bm25 else 0}, {wi}, {rw if s.reranker else 0}::DOUBLE)"
                        )
    ctes["configs"] = f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(n, experiment_name, variant, b, kd, kb, w, rw)"
    names = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in [f"hit@{k}" for k in evaluate.CUTOFFS] + ["mrr"])
    ctes["results"] = f"SELECT n, experiment_name, {names} FROM configs LEFT JOIN means USING (variant, b, kd, kb, w, rw)"
    ctes["judged"] = """SELECT r.*, NOT EXISTS (SELECT 1 FROM results e WHERE e.n < r.n AND (e."hit@1" > r."hit@1" OR (e."hit@1" = r."hit@1"
        AND (e."hit@5" > r."hit@5" OR (e."hit@5" = r."hit@5" AND e.mrr >= r.mrr))))) AS improved FROM results r"""
    ctes["stale"] = """SELECT *, n - 1 - max(CASE WHEN improved THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
        FROM judged"""
    ctes["done"] = """SELECT *, CASE WHEN max((coalesce(s, 0) >= 8)::INT) OVER (ORDER BY n) = 1 THEN 'skipped' ELSE 'completed' END AS status FROM stale"""
    return ctes


_GRID_OUT = ", ".join(["n", "experiment_name", *(f'round("{c}", 9) AS "{c}"' for c in ("hit@1", "hit@3", "hit@5", "hit@10", "mrr")), "improved", "status"])
_GRID_ORDER = 'ORDER BY done."hit@1" DESC, done."hit@5" DESC, done.mrr DESC, n'
_GRID_SQL = _grid_sql()

QUERIES = {
    "eval_as_of": (
        eval_as_of,
        m.with_ctes(
            ("metadata", "vote_links"),
            {
                "corpus": LINKED_SQL["corpus"],
                **m.sql_hash_vectors("cv", "corpus"),
                "timed": "SELECT id, v, created FROM cv JOIN bugs ON bug_id = id",
                "near_pairs": """SELECT q.id AS query_id, c.id AS bug_id, round(list_inner_product(q.v, c.v), 9) AS dense_score
                FROM timed q, timed c WHERE c.created < q.created""",
                "near": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, bug_id) AS raw_rank
                FROM near_pairs) WHERE raw_rank <= 10""",
                **m.sql_vote_score("v", "near", "vote_links", 10, "dense_score"),
                "hits": """SELECT bug_id AS query_id, min(r) AS r FROM (SELECT l.bug_id, v.rank AS r FROM vote_links l
                LEFT JOIN v ON v.query_id = l.bug_id AND v.testcase_id = l.testcase_id) GROUP BY bug_id""",
            },
            """SELECT query_id, coalesce((r <= 1)::INT, 0) AS "hit@1", coalesce((r <= 3)::INT, 0) AS "hit@3", coalesce((r <= 5)::INT, 0) AS "hit@5",
            coalesce((r <= 10)::INT, 0) AS "hit@10", round(coalesce(1.0::DOUBLE / r, 0), 9) AS mrr FROM hits""",
        ),
    ),
    "label_eval": (
        label_eval,
        m.with_ctes(
            ("vectors", "label_links"),
            {
                **m.sql_dense("near", "vectors", "vectors", 10),
                "others": m.sql_without_self("near", 10),
                **m.sql_vote_score("v", "others", "label_links", 10, "dense_score"),
                "hits": """SELECT l.bug_id AS query_id, v.rank AS r FROM label_links l LEFT JOIN v ON v.query_id = l.bug_id
                AND v.testcase_id = l.testcase_id""",
            },
            """SELECT query_id, coalesce((r <= 1)::INT, 0) AS "hit@1", coalesce((r <= 3)::INT, 0) AS "hit@3", coalesce((r <= 5)::INT, 0) AS "hit@5",
            coalesce((r <= 10)::INT, 0) AS "hit@10", round(coalesce(1.0::DOUBLE / r, 0), 9) AS mrr FROM hits""",
        ),
    ),
    "eval_metrics": (
        eval_metrics,
        m.with_ctes(
            ("metadata",),
            _BOTH,
            'SELECT method, query_id, "hit@1", "hit@3", "hit@5", "hit@10", round(mrr, 9) AS mrr FROM metrics',
        ),
    ),
    "eval_summary": (
        eval_summary,
        m.with_ctes(
            ("metadata",),
            _BOTH,
            "SELECT method, count(*) AS queries, "
            + ", ".join(f'round(avg("{c}"), 9) AS "{c}"' for c in ("hit@1", "hit@3", "hit@5", "hit@10", "mrr"))
            + " FROM metrics GROUP BY method",
        ),
    ),
    "eval_per_bug": (
        eval_per_bug,
        m.with_ctes(
            ("metadata",),
            _TABLE,
            """SELECT e.query_id AS bug_id, array_to_string(e.ids, ',') AS ground_truth_testcases,
            """
            + ", ".join(f"coalesce({c}, '') AS {c}" for c in _ID_LISTS[1:5])
            + """, coalesce(hybrid_reranked_predicted_testcases, '') AS predicted_testcases, "hit@1", "hit@3", "hit@5", "hit@10",
            round(mrr, 9) AS mrr, 'hybrid+reranked' AS ranking_method, coalesce(retrieval_scores, '') AS retrieval_scores,
            coalesce(reranker_scores, '') AS reranker_scores, coalesce(final_scores, '') AS final_scores
            FROM expected e JOIN metrics x ON x.query_id = e.query_id AND x.method = 'hybrid_reranked' LEFT JOIN predictions p ON p.query_id = e.query_id""",
        ),
    ),
    "failures_summary": (
        failures_summary,
        m.with_ctes(
            ("metadata",),
            _TABLE,
            f"""SELECT 'evaluated' AS metric, count(*)::DOUBLE AS value FROM expected
            UNION ALL SELECT 'failed', count(*) FROM failed UNION ALL SELECT 'failed_recomputed', count(*) FROM failed
            UNION ALL SELECT 'failed_pct', round((SELECT count(*) FROM failed) / count(*)::DOUBLE * 100, 2) FROM expected
            UNION ALL SELECT 'several_truths', coalesce(sum((n > 1)::INT), 0) FROM truths
            UNION ALL SELECT 'several_truths_pct', round(coalesce(avg((n > 1)::INT::DOUBLE), 0) * 100, 2) FROM truths
            UNION ALL SELECT 'blank_description_pct', round(coalesce(avg(({m.sql_text('bug_description')} = '')::INT::DOUBLE), 0) * 100, 2) FROM described""",
        ),
    ),
    "failed_ids": (
        failed_ids,
        m.with_ctes(
            ("metadata",),
            {
                **_TABLE,
                "predicted_counts": """SELECT testcase_id, count(*) AS n FROM lists JOIN failed USING (query_id) WHERE method = 'hybrid_reranked'
                GROUP BY 1 ORDER BY n DESC, testcase_id LIMIT 10""",
            },
            "SELECT *, 'truth' AS kind FROM truth_counts UNION ALL SELECT *, 'predicted' FROM predicted_counts",
        ),
    ),
    "failure_causes": (
        failure_causes,
        m.with_ctes(
            ("metadata",),
            _TABLE,
            f"""SELECT '{diagnose.CAUSE_SPARSE}' AS cause, 1::BIGINT AS n FROM (SELECT avg(({m.sql_text('bug_description')} = '')::INT) * 100 AS p FROM described) WHERE p > 20
            UNION ALL SELECT '{diagnose.CAUSE_AMBIGUOUS}', 1 FROM (SELECT max(n) AS x FROM truth_counts) WHERE x > 10
            UNION ALL SELECT '{diagnose.CAUSE_GENERIC}', 1 WHERE EXISTS (SELECT 1 FROM title_tokens WHERE token IN {diagnose.GENERIC_TOKENS})
            UNION ALL SELECT '{diagnose.CAUSE_MISS}', 1
            UNION ALL SELECT 'severity ' || coalesce(severity, '<missing>'), count(*) FROM described GROUP BY 1
            UNION ALL SELECT '{diagnose.ROW_CAUSE_MISS}', count(*) FROM failed HAVING count(*) > 0
            UNION ALL SELECT '{diagnose.ROW_CAUSE_AMBIGUOUS}', count(*) FROM truths WHERE n > 1 HAVING count(*) > 0""",
        ),
    ),
    "coverage_slices": (
        coverage_slices,
        m.with_ctes(
            ("metadata",),
            {
                **_TABLE,
                "item_bugs": "SELECT testcase_id, count(DISTINCT bug_id) AS n FROM vote_links GROUP BY 1",
                "best": "SELECT bug_id, max(n) - 1 AS o FROM vote_links JOIN item_bugs USING (testcase_id) GROUP BY 1",
            },
            """SELECT CASE WHEN o = 0 THEN 'cold' WHEN o <= 2 THEN 'sparse' ELSE 'covered' END AS coverage, count(*) AS bugs,
            sum((bug_id IN (SELECT query_id FROM failed))::INT)::BIGINT AS failed FROM best GROUP BY 1""",
        ),
    ),
    "failure_report": (
        failure_report,
        m.with_ctes(
            ("metadata",),
            {
                **_TABLE,
                "predicted_counts": """SELECT testcase_id, count(*) AS n FROM lists JOIN failed USING (query_id) WHERE method = 'hybrid_reranked'
                GROUP BY 1 ORDER BY n DESC, testcase_id LIMIT 10""",
                "top_tokens": _TABLE["title_tokens"].replace("LIMIT 10", "LIMIT 20"),
                "shown": "SELECT query_id FROM failed ORDER BY query_id LIMIT 20",
            },
            f"""SELECT 'overview' AS section, 'evaluated' AS key, count(*)::VARCHAR AS value FROM expected
            UNION ALL SELECT 'overview', 'failed', count(*)::VARCHAR FROM failed
            UNION ALL SELECT 'overview', 'failed_pct', printf('%.2f', round((SELECT count(*) FROM failed) / count(*)::DOUBLE * 100, 2)) FROM expected
            UNION ALL SELECT 'overview', 'several_truths', coalesce(sum((n > 1)::INT), 0)::VARCHAR FROM truths
            UNION ALL SELECT 'overview', 'several_truths_pct', printf('%.2f', round(coalesce(avg((n > 1)::INT::DOUBLE), 0) * 100, 2)) FROM truths
            UNION ALL SELECT 'overview', 'blank_description_pct',
                printf('%.2f', round(coalesce(avg(({m.sql_text('bug_description')} = '')::INT::DOUBLE), 0) * 100, 2)) FROM described
            UNION ALL SELECT 'failed_truth', testcase_id::VARCHAR, n::VARCHAR FROM truth_counts
            UNION ALL SELECT 'failed_prediction', testcase_id::VARCHAR, n::VARCHAR FROM predicted_counts
            UNION ALL SELECT 'severity', coalesce(severity, '<missing>'), count(*)::VARCHAR FROM described GROUP BY severity
            UNION ALL SELECT 'title_token', token, n::VARCHAR FROM top_tokens
            UNION ALL SELECT 'cause', '{diagnose.CAUSE_SPARSE}', '1' FROM (
                SELECT avg(({m.sql_text('bug_description')} = '')::INT) * 100 AS p FROM described) WHERE p > 20
            UNION ALL SELECT 'cause', '{diagnose.CAUSE_AMBIGUOUS}', '1' FROM (SELECT max(n) AS x FROM truth_counts) WHERE x > 10
            UNION ALL SELECT 'cause', '{diagnose.CAUSE_GENERIC}', '1' WHERE EXISTS (SELECT 1 FROM title_tokens WHERE token IN {diagnose.GENERIC_TOKENS})
            UNION ALL SELECT 'cause', '{diagnose.CAUSE_MISS}', '1'
            UNION ALL SELECT 'example', s.query_id::VARCHAR, concat_ws(' | ', bug_title, 'severity=' || coalesce(severity, '<missing>'),
                'truth=[' || array_to_string(t.ids, ', ') || ']',
                'predicted=[' || replace(coalesce(p.hybrid_reranked_predicted_testcases, ''), ',', ', ') || ']')
                FROM shown s JOIN truths t USING (query_id) LEFT JOIN metadata b ON b.bug_id = s.query_id LEFT JOIN predictions p ON p.query_id = s.query_id""",
        ),
    ),
    "grid_results": (grid_results, m.with_ctes(("bugs", "vote_links"), _GRID_SQL, f"SELECT {_GRID_OUT} FROM done")),
    "grid_leaderboard": (
        grid_leaderboard,
        m.with_ctes(("bugs", "vote_links"), _GRID_SQL, f"SELECT {_GRID_OUT} FROM done {_GRID_ORDER} LIMIT 10"),
    ),
    "grid_best": (
        grid_best,
        m.with_ctes(("bugs", "vote_links"), _GRID_SQL, f"SELECT {_GRID_OUT} FROM done WHERE status = 'completed' {_GRID_ORDER} LIMIT 1"),
    ),
}
