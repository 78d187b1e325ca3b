"""Training pairs and the learned ranker; staged tables of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.plans import training
from rankjobs.sources import artifacts


def test_ranker_scores_all_pairs_and_finds_the_linked_ones(spark):
    rows = [(b, t, int(b % 3 == t % 3), int(b % 2 == t % 2), 1.0 if b == t else 0.1, 0.5) for b in range(40) for t in range(40)]
    pairs = spark.createDataFrame(rows, ["bug_id", "testcase_id", *training.FEATURES]).withColumn("retrieval", F.lit(0.5))
    positives, negatives = pairs.filter("bug_id = testcase_id"), pairs.filter("bug_id <> testcase_id")
    model = training.fit_ranker(positives, negatives, fit_rows=500)
    ranked = training.rank_pairs(pairs, model, "retrieval", k=None)
    assert ranked.count() == 1600
    assert ranked.filter("rank = 1 AND bug_id = testcase_id").count() == 40


def test_tree_ranker_against_slow_ranking(spark):
    rows = [(b, t, int((b + t) % 3 == 0), int(b % 2 == t % 2), round(abs(b - t) / 40, 3), 0.5, ((b * 7 + t * 3) % 11) / 10) for b in range(30) for t in range(30)]
    pairs = spark.createDataFrame(rows, ["bug_id", "testcase_id", *training.FEATURES, "retrieval"]).repartition(3)
    # linked where areas agree and tags are far apart: no single feature tells
    linked = "area_match = 1 AND tag_overlap > 0.3"
    model = training.fit_tree_ranker(pairs.filter(linked), pairs.filter(f"NOT ({linked})"), fit_rows=600)
    got = {(r["bug_id"], r["testcase_id"]): r for r in training.rank_pairs(pairs, model, "retrieval", k=5).collect()}
    from pyspark.ml.linalg import Vectors

    scores = {}
    for b, t, *features, retrieval in rows:
        score = min(1.0, max(0.0, model.predict(Vectors.dense(features))))
        scores.setdefault(b, []).append((-round(0.5 * retrieval + 0.5 * score, 9), t, score))
    assert len(got) == 30 * 5
    for b, found in scores.items():
        for rank, (final, t, score) in enumerate(sorted(found)[:5], 1):
            row = got[b, t]
            assert (row["rank"], row["final_score"]) == (rank, -final) and abs(row["ranker_score"] - score) < 1e-12
    right = [s > 0.5 for b, t, *f, _ in rows for s in [next(x[2] for x in scores[b] if x[1] == t)] if f[0] and f[2] > 0.3]
    assert sum(right) > 0.9 * len(right)


def test_tree_ranker_learns_from_all_pairs(spark):
    order = ["bug_id", "testcase_id"]
    plain = F.lit(0.0)
    base = spark.range(230_000).select(F.col("id").alias("bug_id"), (F.col("id") + 7).alias("testcase_id"))
    last = base.orderBy(F.xxhash64(*order), *order).offset(200_000).withColumn("late", F.lit(1.0))
    linked = base.join(last, order, "left").select(
        *order, plain.alias("area_match"), plain.alias("priority_match"), F.coalesce("late", plain).alias("tag_overlap"),
        (F.col("bug_id") / 230_000).alias("recency"),
    )
    # of pairs with equal tags many are linked, which only those after the first 200,000 show
    others = spark.range(300).select(
        F.col("id").alias("bug_id"), F.col("id").alias("testcase_id"), plain.alias("area_match"), plain.alias("priority_match"),
        F.lit(1.0).alias("tag_overlap"), (F.col("id") / 300).alias("recency"),
    )
    model = training.fit_tree_ranker(linked, others, trees=3)
    assert model.getMaxBins() ** 2 >= 230_000
    scored = training.scored_pairs(linked.filter("tag_overlap = 1").limit(500), model)
    assert scored.agg(F.min("ranker_score")).first()[0] > 0.5


def test_equal_pairs_count_as_often_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(training, "THRESHOLD_ROWS", 100)
    rows = [(b, t, int(b % 3 == t % 3), int(b % 2 == t % 2), float(b % 4) / 4, 0.5) for b in range(40) for t in range(40)]
    pairs = spark.createDataFrame(rows, ["bug_id", "testcase_id", *training.FEATURES])
    linked = "area_match = 1 AND (tag_overlap > 0.3 OR bug_id < 9)"
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = training.fit_tree_ranker(pairs.filter(linked), pairs.filter(f"NOT ({linked})"), trees=5)
    one_by_one = pairs.withColumn("label", F.expr(f"double({linked})"))
    assembled = VectorAssembler(inputCols=list(training.FEATURES), outputCol="f").transform(one_by_one)
    plain = GBTRegressor(featuresCol="f", labelCol="label", maxIter=5, maxDepth=3, stepSize=0.2, seed=7).fit(assembled)
    other = {(r["bug_id"], r["testcase_id"]): min(1.0, max(0.0, r["prediction"])) for r in plain.transform(assembled).collect()}
    got = training.scored_pairs(pairs, model).collect()
    assert len(got) == 1600 and all(abs(r["ranker_score"] - other[r["bug_id"], r["testcase_id"]]) < 1e-9 for r in got)


def test_ranker_without_one_kind_scores_all_alike(spark):
    rows = [(1, t, 0, 1, 0.1 * t, 0.5, 0.2 * t) for t in range(4)]
    pairs = spark.createDataFrame(rows, ["bug_id", "testcase_id", *training.FEATURES, "retrieval"])
    model = training.fit_tree_ranker(pairs, pairs.limit(0))
    assert model is None
    got = training.rank_pairs(pairs, model, "retrieval").orderBy("rank").collect()
    assert [r["testcase_id"] for r in got] == [3, 2, 1, 0] and {r["ranker_score"] for r in got} == {0.5}


def test_candidates_are_shares_of_the_best_vote(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 1, -0.5)], "query_id bigint, bug_id bigint, hybrid_score double")
    links = spark.createDataFrame([(2, 7, "a"), (3, 7, "a"), (3, 8, "b"), (1, 9, "c")], "bug_id bigint, testcase_id bigint, testcase_title string")
    got = {(r["bug_id"], r["testcase_id"]): r["retrieval"] for r in training.candidates(near, links).collect()}
    assert got == {(1, 7): 1.0, (1, 8): 0.25 / 0.75, (2, 9): 0.0}


def test_missing_values_match_nothing(spark):
    bugs = spark.createDataFrame([(1, None, None, None, None)], "bug_id bigint, a string, p string, t string, d date")
    cases = spark.createDataFrame([(7, None, None, None)], "testcase_id bigint, a string, p string, t string")
    pairs = spark.createDataFrame([(1, 7)], "bug_id bigint, testcase_id bigint")
    both = lambda c: (F.col(c), F.col(c))
    row = training.pair_features(pairs, bugs, cases, area=both("a"), priority=both("p"), tags=both("t"), time=F.col("d")).first()
    assert (row["area_match"], row["priority_match"], row["tag_overlap"], row["recency"]) == (0, 0, 0.0, 0.0)


def test_staged_tables_of_a_scope_are_removed(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(artifacts.application_folder(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {str(x.getPath()) for x in system.listStatus(folder)} if system.exists(folder) else set()
    kept = artifacts.stage(spark.range(3), "kept")
    before = names()
    with artifacts.staged_scope(spark):
        assert artifacts.stage(spark.range(5), "inner").count() == 5
        assert len(names()) == len(before) + 1
    assert names() == before and kept.count() == 3


def test_a_stream_leaves_no_staged_tables(spark, tmp_path):
    from rankjobs.operators import bm25, embed
    from rankjobs.plans.recommend import Corpus
    from rankjobs.streaming.new_items import recommend_stream

    texts = spark.createDataFrame([(i, f"word{i % 5} common text {i}") for i in range(20)], "bug_id bigint, bug_text_enriched string")
    links = spark.createDataFrame([(i, i % 4, f"case {i % 4}") for i in range(20)], "bug_id bigint, testcase_id bigint, testcase_title string")
    vectors = artifacts.stage(embed.token_hash_vectors(texts, "bug_id", "bug_text_enriched", dim=32), "v")
    corpus = Corpus(vectors, bm25.build_index(texts), links)
    for k in range(3):
        spark.createDataFrame([(100 + k, f"word{k} common")], "query_id bigint, query_text string").write.mode("append").parquet(f"{tmp_path}/in")
    folder = spark._jvm.org.apache.hadoop.fs.Path(artifacts.application_folder(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(system.listStatus(folder))
    stream = spark.readStream.schema("query_id bigint, query_text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    vectorize = lambda q: embed.token_hash_vectors(q, "query_id", "query_text", dim=32, as_query=True)
    recommend_stream(stream, corpus, vectorize, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("query_id").distinct().count() == 3
    assert len(system.listStatus(folder)) == before


def test_areas_are_paths(spark):
    from rankjobs.operators import profile

    bugs = spark.createDataFrame(
        [(1, "a\\b\\c", ["x", "y", None]), (2, " a \\ b\\", []), (3, None, None), (4, "", ["x"]), (5, "z", ["q"])], "bug_id bigint, a string, t array<string>"
    )
    cases = spark.createDataFrame([(7, "a\\b\\d", ["y", "x"]), (8, "a", None), (9, None, ["q"])], "testcase_id bigint, a string, t array<string>")
    got = {(r["level"], r["area"]): (r["bugs"], r["testcases"]) for r in profile.area_overlap_levels(bugs, cases, "a", "a").collect()}
    assert got == {
        (0, ""): (5, 3), (1, "a"): (2, 2), (2, "a\\b"): (2, 1), (3, "a\\b\\c"): (1, 0), (3, "a\\b\\d"): (0, 1), (1, "z"): (1, 0),
    }
    pairs = bugs.select("bug_id").join(cases.select("testcase_id"))
    none = (F.lit(None).cast("string"), F.lit(None).cast("string"))
    both = lambda c: (F.col(c), F.col(c))
    rows = training.pair_features(pairs, bugs, cases, area=both("a"), priority=none, tags=both("t"), time=F.lit(None).cast("date")).collect()
    assert {(r["bug_id"], r["testcase_id"]): r["area_depth"] for r in rows if r["area_depth"]} == {(1, 7): 2, (1, 8): 1, (2, 7): 2, (2, 8): 1}
    assert {(r["bug_id"], r["testcase_id"]): r["tag_overlap"] for r in rows if r["tag_overlap"]} == {(1, 7): 1.0, (4, 7): 0.5, (5, 9): 1.0}
    assert len(rows) == 15
