"""Vector, BM25 and fused retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.operators import bm25, cells, dense, embed, fuse
from rankjobs.plans import evaluate
from rankjobs.queries import model as m
from rankjobs.sources.artifacts import stage


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 9) for c in names})


def _vector_sides(spark, sf):
    vectors = stage(m.vectors(spark, sf), "vectors")
    return vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "bug_id")


def dense_topk(spark, sf):
    return _rounded(dense.dense_neighbours(*_vector_sides(spark, sf), 10, exclude="none").drop("dense_rank"), "dense_score")


def dense_topk_cells(spark, sf):
    """The lists of ``dense_topk``, found by cells and bounds."""
    return _rounded(cells.cell_top_k(*_vector_sides(spark, sf), 10), "dense_score")


def dense_topk_excl(spark, sf):
    return _rounded(dense.dense_neighbours(*_vector_sides(spark, sf), 10), "dense_score")


def dense_topk_others(spark, sf):
    return _rounded(dense.dense_neighbours(*_vector_sides(spark, sf), 10, exclude="before"), "dense_score")


def embed_tokens(spark, sf):
    vectors = embed.token_hash_vectors(m.documents(spark, sf), "doc_id", "text", dim=m.VECTOR_DIM)
    return embed.weights(vectors, "doc_id")


def embed_ml(spark, sf):
    return embed.tf_idf_vectors(m.documents(spark, sf), "doc_id", "text", dim=1024)


def _document_index(spark, sf):
    return bm25.build_index(m.documents(spark, sf), "doc_id", "text")


def bm25_stats(spark, sf):
    return _rounded(bm25.statistics(_document_index(spark, sf)), "mean_length", "mean_idf")


def bm25_idf(spark, sf):
    return _rounded(_document_index(spark, sf).idf(), "idf")


def bm25_topk(spark, sf):
    queries = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return _rounded(bm25.bm25_top_k(queries, _document_index(spark, sf), 10))


def bm25_self(spark, sf):
    """Every document against all others."""
    return _rounded(bm25.bm25_top_k(None, _document_index(spark, sf), 10, exclude_self=True))


def bm25_passage_hits(spark, sf):
    """Do the documents that hold a passage come first when the passage is the query?

    The true pairs come from a word all texts of a pair share: the longest word of
    the passage, looked up in the words of the documents, then checked by containment.
    """
    docs = m.documents(spark, sf)
    items = m.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = bm25.bm25_top_k(items, bm25.build_index(docs, "doc_id", "text"), 10)
    predicted = found.select("query_id", F.col("bug_id").alias("testcase_id"), F.col("bm25_rank").alias("rank"))
    truth = stage(passage_pairs(docs, items), "passages")
    asked = truth.select("query_id").distinct()
    return _rounded(evaluate.metrics_per_query(predicted, truth, asked), "mrr")


def passage_pairs(docs, items):
    """``(query_id, testcase_id)`` where the document contains the whole passage.

    Instead of testing all pairs, a pair must share the passage's rarest inner word. A
    passage may begin or end inside a word of the document, so those two are not used.
    A passage without an inner word is looked up by its longest run of word characters, or
    of others, among the pieces of that length of the documents' runs.
    """
    words = F.regexp_extract_all(F.col("query_text"), F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"), F.lit(0))
    doc_words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    item_words = items.select("query_id", F.explode(F.array_distinct(words)).alias("word"))
    spread = doc_words.join(item_words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(
        F.count(F.lit(1)).alias("docs")
    )
    key = (
        item_words.join(spread, "word", "left")
        .groupBy("query_id")
        .agg(F.min_by("word", F.struct(F.coalesce("docs", F.lit(0)), F.col("word"))).alias("word"))
    )
    candidates = doc_words.join(key, "word").select("query_id", "doc_id")
    candidates = candidates.unionByName(_short_candidates(docs, items.join(key, "query_id", "left_anti")))
    return (
        candidates.join(items, "query_id")
        .join(docs.select("doc_id", "text"), "doc_id")
        .filter(F.contains("text", "query_text"))
        .select("query_id", F.col("doc_id").alias("testcase_id"))
    )


def _short_candidates(docs, items):
    """``(query_id, doc_id)`` where a run of the document has the longest run of the passage as a piece."""
    runs = F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+")
    own = items.select("query_id", F.explode(F.regexp_extract_all("query_text", runs, F.lit(0))).alias("run"))
    longest = stage(own.groupBy("query_id").agg(F.max_by("run", F.struct(F.length("run"), F.col("run"))).alias("piece")), "pieces")
    sizes = longest.select(F.length("piece").alias("size")).distinct()
    doc_runs = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", runs, F.lit(0)))).alias("run"))
    # the lengths that occur are few, and only runs that are long enough are cut
    pieces = (
        doc_runs.join(sizes, F.length("run") >= F.col("size"))
        .select("doc_id", "run", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("at"))
        .select("doc_id", F.substring("run", F.col("at"), F.col("size")).alias("piece"))
    )
    return pieces.join(longest, "piece").select("query_id", "doc_id").distinct()


def rrf(spark, sf):
    """Every linked bug, by vectors and by words."""
    _, corpus = m.history(spark, sf)
    queries = corpus.vectors.withColumnRenamed("bug_id", "query_id")
    near = dense.dense_neighbours(queries, corpus.vectors, 10)
    words = bm25.bm25_top_k(None, corpus.index, 10, exclude_self=True)
    fused = fuse.rrf(near, words, 10).withColumn("hybrid_score", F.round("hybrid_score", 9))
    return _rounded(fused, "dense_score")


_DOCS = {"docs": "SELECT doc_id AS id, text FROM documents", "items": "SELECT item_id AS id, text FROM benchmark"}
_STATS = {**_DOCS, **m.sql_bm25_stats("c", "docs")}
_NEAR = m.sql_dense("near", "vectors", "vectors", 10)
_NEAR_DEEP = m.sql_dense("near", "vectors", "vectors", 11)

LINKED_SQL = {
    "corpus": "SELECT bug_id AS id, bug_text_enriched AS text FROM metadata",
    **m.sql_hash_vectors("cv", "corpus"),
    **m.sql_bm25_stats("c", "corpus"),
}

QUERIES = {
    "dense_topk": (
        dense_topk,
        m.with_ctes(("vectors",), _NEAR, "SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, raw_rank FROM near"),
    ),
    "dense_topk_cells": (
        dense_topk_cells,
        m.with_ctes(("vectors",), _NEAR, "SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, raw_rank FROM near"),
    ),
    "dense_topk_excl": (
        dense_topk_excl,
        m.with_ctes(
            ("vectors",),
            {**_NEAR, "others": m.sql_without_self("near", 10)},
            "SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, raw_rank, dense_rank FROM others",
        ),
    ),
    "dense_topk_others": (
        dense_topk_others,
        m.with_ctes(
            ("vectors",),
            {**_NEAR_DEEP, "others": m.sql_without_self("near", 11)},
            "SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, raw_rank, dense_rank FROM others WHERE dense_rank <= 10",
        ),
    ),
    "embed_tokens": (
        embed_tokens,
        m.with_ctes(
            (),
            {"docs": _DOCS["docs"], **{k: v for k, v in m.sql_hash_vectors("v", "docs").items() if k != "v"}},
            "SELECT id AS doc_id, bucket, round((n / norm)::FLOAT::DOUBLE, 6) AS weight FROM v_cells JOIN v_norms USING (id)",
        ),
    ),
    "embed_ml": (embed_ml, None),
    "bm25_stats": (
        bm25_stats,
        m.with_ctes(
            (),
            _STATS,
            """SELECT s.n::BIGINT AS n_docs, round(s.mean_length, 9) AS mean_length, round(mean_idf, 9) AS mean_idf,
            (SELECT count(*) FROM c_df) AS terms, (SELECT count(*) FROM c_tf) AS postings FROM c_size s, c_mean""",
        ),
    ),
    "bm25_idf": (bm25_idf, m.with_ctes((), _STATS, "SELECT t AS term, df, round(idf, 9) AS idf FROM c_idf")),
    "bm25_topk": (
        bm25_topk,
        m.with_ctes(
            (),
            {**_STATS, **m.sql_bm25("words", "c", "items", 10, False)},
            "SELECT query_id, bug_id, bm25_score, bm25_rank FROM words",
        ),
    ),
    "bm25_self": (
        bm25_self,
        m.with_ctes(
            (),
            {**_STATS, **m.sql_bm25("words", "c", "docs", 10, True)},
            "SELECT query_id, bug_id, bm25_score, bm25_rank FROM words",
        ),
    ),
    "bm25_passage_hits": (
        bm25_passage_hits,
        m.with_ctes(
            (),
            {
                **_STATS,
                **m.sql_bm25("words", "c", "items", 10, False),
                "truth": "SELECT i.id AS query_id, d.id AS doc_id FROM items i JOIN docs d ON contains(d.text, i.text)",
                "hits": """SELECT t.query_id, min(w.bm25_rank) AS r FROM truth t
                LEFT JOIN words w ON w.query_id = t.query_id AND w.bug_id = t.doc_id GROUP BY 1""",
            },
            """SELECT query_id, coalesce((r <= 1)::INT, 0) AS "hit@1", coalesce((r <= 3)::INT, 0) AS "hit@3", coalesce((r <= 5)::INT, 0) AS "hit@5",
            coalesce((r <= 10)::INT, 0) AS "hit@10", round(coalesce(1.0::DOUBLE / r, 0), 9) AS mrr FROM hits""",
        ),
    ),
    "rrf": (
        rrf,
        m.with_ctes(
            ("metadata",),
            {
                **LINKED_SQL,
                **m.sql_dense("near", "cv", "cv", 10),
                "others": m.sql_without_self("near", 10),
                **m.sql_bm25("words", "c", "corpus", 10, True),
                **m.sql_rrf("fused", "others", "words", 10),
            },
            """SELECT query_id, bug_id, round(dense_score, 9) AS dense_score, dense_rank, bm25_score, bm25_rank,
            round(hybrid_score, 9) AS hybrid_score, hybrid_rank FROM fused""",
        ),
    ),
}
