"""Inputs that earlier versions got wrong: large ids, words in id lists, incomplete vectors, late zeros."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.functions.numeric import to_id
from rankjobs.operators import dense, links, profile
from rankjobs.plans import evaluate
from rankjobs.sources import artifacts, items, tables

LARGE = 9007199254740993


def test_large_ids_stay_exact(spark, tmp_path):
    df = spark.createDataFrame([(str(LARGE), f"[{LARGE}, 2.0, nan, 1e30, x]")], "id string, ids string")
    row = df.select(to_id("id").alias("id"), tx.parse_id_list("ids").alias("ids")).first()
    assert row["id"] == LARGE and row["ids"] == [LARGE, 2]
    path = str(tmp_path / "ids")
    tables.write_csv(df.select("id"), path)
    schema = spark.createDataFrame([], "id bigint").schema
    assert tables.read_csv(spark, path, schema).first()["id"] == LARGE
    raw = spark.createDataFrame([(str(LARGE), str(LARGE - 1))], "WorkItemId string, LinkedWorkItemId string").withColumn("LinkedType", F.lit("t"))
    assert links.numeric_links(raw).first().asDict() == {"from_id": LARGE, "to_id": LARGE - 1, "link_type": "t"}


@pytest.mark.parametrize("bad", [None, [None, 1.0], [1.0]])
def test_incomplete_vectors_raise(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "bug_id bigint, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="vector of bug_id 2"):
        dense.pack_vectors(df, "bug_id").collect()


def test_content_key_of_many_equal_rows(spark):
    assert len(artifacts.content_key(spark.range(400_000).select(F.lit("same").alias("a")), {})) == 16


def test_deviation_of_large_values(spark):
    df = spark.createDataFrame([(1e9,)] * 500 + [(1e9 + 1,)] * 500, "v double")
    assert abs(profile.describe(df, "v").first()["std"] - 0.50025) < 1e-4


def test_rows_without_a_time_are_kept(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-01"), (3, None)], "id int, at string").withColumn("at", F.to_timestamp("at"))
    for undated in ("before", "after"):
        parts = evaluate.time_split(df, "at", at="2020-06-01", undated=undated)
        assert sum(p.count() for p in parts) == 3


def test_missing_master_columns_are_named(spark):
    bugs = spark.createDataFrame([], "bug_id bigint, bug_title string")
    raw = spark.createDataFrame([], "from_id string, to_id string")
    with pytest.raises(ValueError, match="priority"):
        links.build_master(raw, bugs, bugs)


def test_steps(spark):
    rows = [
        (1, "&lt;steps xmlns=\"u\"&gt;&lt;step&gt;&lt;a&gt;do &amp;lt;b&amp;gt;it&amp;lt;/b&amp;gt;&lt;/a&gt;&lt;a&gt;see&lt;/a&gt;&lt;/step&gt;&lt;step/&gt;&lt;step&gt;&lt;a/&gt;&lt;a&gt;x&lt;/a&gt;&lt;/step&gt;&lt;/steps&gt;"),
        (2, "<steps>only text</steps>"),
        (3, "<steps><step>"),
        (4, None),
        (5, "   "),
    ]
    got = {r["id"]: (r["test_steps"], r["expected_results"]) for r in items.flatten_steps(spark.createDataFrame(rows, "id int, m string"), "m").collect()}
    assert got == {1: ("1. do it\n3. x", "1. see"), 2: ("only text", None), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_one_row_per_id_does_not_depend_on_order(spark):
    rows = [(1, "b"), (1, "a"), (None, "z"), (None, "y"), (2, None), (2, "c")]
    for order in (rows, rows[::-1]):
        got = items.one_per_id(spark.createDataFrame(order, "k int, v string").repartition(3), "k").collect()
        assert sorted((r["k"] or 0, r["v"]) for r in got if r["v"]) == [(0, "y"), (1, "a")] and len(got) == 3


def test_unescape_leaves_plain_texts_and_nulls(spark):
    df = spark.createDataFrame([("a &amp; b",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.unescape_entities("t")).collect()] == ["a & b", "plain", None]


def test_short_passages_are_found(spark):
    from rankjobs.queries.retrieval import passage_pairs

    docs = [(1, "one two three"), (2, "someone twofold"), (3, "...!?"), (4, "three"), (5, "a b c d e")]
    items = [(10, "one two"), (11, "two"), (12, "!?"), (13, "hre"), (14, "a b c d"), (15, "zzz"), (16, "one tw")]
    got = passage_pairs(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "query_id bigint, query_text string")
    )
    assert {tuple(r) for r in got.collect()} == {(q, d) for q, t in items for d, u in docs if t in u}


def test_bounds_of_a_hot_list_come_from_an_aggregation(spark, capsys):
    from rankjobs.functions.numeric import with_min_max

    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit(None)).otherwise(F.col("id") % 5).alias("q"), (F.col("id") % 100).cast("double").alias("v")
    )
    out = with_min_max(rows, {"s": "v"}, ["q"])
    out.explain()
    assert "Window" not in capsys.readouterr().out
    assert out.count() == 3000 and out.filter("q IS NULL").agg(F.min("s"), F.max("s")).first()[:] == (0.0, 1.0)
