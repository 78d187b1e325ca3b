"""CSV encodings and cells, work items, artifacts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankjobs.sources import artifacts, items, tables


def test_csv_quotes_newlines_and_null_words(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"a ""b""\nc"\n2,NA\n3,nan\n4.0,x\nzz,y\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    rows = [tuple(r) for r in tables.read_csv(spark, str(path), schema).collect()]
    assert rows == [(1, 'a "b"\nc'), (2, None), (3, None), (4, "x"), (None, "y")]


@pytest.mark.parametrize(
    "raw, encoding, text",
    [
        ("id,t\n1,é€\n".encode(), "UTF-8", "é€"),
        ("id,t\n1,é€\n".encode("utf-8-sig"), "UTF-8", "é€"),
        ("id,t\n1,é €“\n".encode("cp1252"), "windows-1252", "é €“"),
        (b"id,t\n1,\xe9\x81\n", "ISO-8859-1", "é\x81"),
    ],
)
def test_encoding_fallback(spark, tmp_path, raw, encoding, text):
    path = tmp_path / "b.csv"
    path.write_bytes(raw)
    assert tables.detect_encoding(spark, str(path)) == encoding
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["id", "t"]
    assert df.first().t == text


def test_required_columns(spark):
    df = spark.range(1)
    assert tables.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="missing required columns: \\['a', 'b'\\]"):
        tables.require_columns(df, ["id", "a", "b"])


def test_optional_columns(spark):
    df = tables.project_with_optional(spark.range(1), ["id"], {"note": "string"})
    assert df.columns == ["id", "note"] and df.first().note is None
    with pytest.raises(ValueError):
        tables.project_with_optional(spark.range(1), ["nope"], {})


def test_empty_csv_keeps_its_header(spark, tmp_path):
    tables.write_csv(spark.range(0), str(tmp_path / "e"))
    assert "id" in "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))


def test_csv_lists_become_json(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, [3, 4])], "id bigint, ids array<bigint>"), str(tmp_path / "l"))
    assert tables.read_csv(spark, str(tmp_path / "l")).first().ids == "[3,4]"


def test_sorted_json(spark):
    df = spark.createDataFrame([(1, None)], "b bigint, a string")
    assert df.select(tables.sorted_json(df, ["b", "a"]).alias("j")).first().j == '{"a":null,"b":1}'


STEPS = [
    ("<steps><step><a>do</a><b>see</b></step><step/><step><a/><b>late</b></step></steps>", "1. do\n3. late", "1. see"),
    ("<steps><step>", None, None),
    ("broken <b>text", "broken text", None),
    (None, None, None),
    ("  ", None, None),
    ('<steps xmlns="u"><step><a>x<i>y</i>tail</a></step></steps>', "1. x y", None),
    ("<steps>only text</steps>", "only text", None),
    ("&lt;steps&gt;&lt;step&gt;&lt;a&gt;go&lt;/a&gt;&lt;/step&gt;&lt;/steps&gt;", "1. go", None),
]


@pytest.mark.parametrize("markup, actions, expected", STEPS)
def test_steps(spark, markup, actions, expected):
    row = items.flatten_steps(spark.createDataFrame([(markup,)], "x string"), "x").first()
    assert (row.test_steps, row.expected_results) == (actions, expected)


def test_work_items(spark, tmp_path):
    lines = [
        {"id": 5, "fields": {"System.WorkItemType": "Bug", "System.Title": "<b>T</b>", "System.Tags": "a;b", "Microsoft.VSTS.Common.Priority": 2}},
        {"id": 0, "fields": {"System.WorkItemType": "Bug", "System.Id": "6"}},
        {"id": 5, "fields": {"System.WorkItemType": "Bug", "System.Title": "<b>T</b>", "System.Tags": "a;b", "Microsoft.VSTS.Common.Priority": 2}},
        {"id": 7, "fields": {"System.WorkItemType": "Test Case", "System.Title": "C"}},
    ]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, lines)))
    read = items.read_work_items(spark, str(tmp_path / "i.json"))
    bugs = {r.bug_id: r for r in items.flatten_bugs(items.of_type(read, "Bug")).collect()}
    assert sorted(bugs) == [5, 6]
    assert (bugs[5].bug_title, bugs[5].bug_tags, bugs[5].priority) == ("T", "a; b", "2")
    cases = items.flatten_testcases(items.of_type(read, "Test Case")).collect()
    assert [(c.testcase_id, c.testcase_title, c.test_steps) for c in cases] == [(7, "C", None)]


def test_vector_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>")
    assert artifacts.check_vectors(good) == 2
    artifacts.save_vectors(good, str(tmp_path / "v"))
    assert artifacts.load_vectors(spark, str(tmp_path / "v")).count() == 2
    bad = good.union(spark.createDataFrame([(3, [1.0])], good.schema))
    with pytest.raises(ValueError, match="one length"):
        artifacts.check_vectors(bad)


def test_artifact_cache_follows_content(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("twice", F.col("id") * 2)

    folder = str(tmp_path / "cache")
    for rows, settings in ((3, {"a": 1}), (3, {"a": 1}), (4, {"a": 1}), (3, {"a": 2})):
        out = artifacts.cached_artifact(spark.range(rows), settings, folder, build)
        assert out.count() == rows
    assert len(calls) == 3


def test_stage_reads_back(spark):
    assert artifacts.stage(spark.range(5), "t").count() == 5


def test_a_refresh_builds_only_new_and_changed_rows(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def build(df):
        def run(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame.assign(size=frame["text"].fillna("").str.len())[["id", "size"]]

        return df.select("id", "text").mapInPandas(run, "id bigint, size bigint")

    def refresh(rows, settings=None):
        seen.value = 0
        df = spark.createDataFrame(rows, "id bigint, text string, `a.b` int")
        found = artifacts.refreshed_artifact(df, "id", settings or {"v": 1}, str(tmp_path / "a"), build)
        assert seen.value == found.built
        return sorted((r["id"] if r["id"] is not None else -1, r["size"]) for r in found.rows.collect()), (found.built, found.kept, found.removed)

    first = [(i, "x" * i, 0) for i in range(10)]
    want = [(i, i) for i in range(10)]
    assert refresh(first) == (want, (10, 0, 0))
    assert refresh(first) == (want, (0, 10, 0))
    # one changed, one gone, one new; rows without id or text; an id with two texts; an equal row twice
    second = [*first[:8], (8, "new", 0), (20, None, 0), (None, "ab", 0), (3, "twice", 0), (3, "twice", 0)]
    full = sorted([(i, i) for i in range(8)] + [(8, 3), (20, 0), (-1, 2), (3, 5)])
    assert refresh(second) == (full, (4, 8, 2))
    assert refresh([]) == ([], (0, 0, 12))
    assert refresh(second) == (full, (12, 0, 0))
    assert refresh(second, {"v": 2}) == (full, (12, 0, 0))


def test_a_refresh_that_was_cut_short_does_not_count(spark, tmp_path):
    build = lambda df: df.select("id")
    for _ in range(2):
        found = artifacts.refreshed_artifact(spark.range(5), "id", {}, str(tmp_path / "a"), build)
    version = next((tmp_path / "a").glob("*/1"))
    (version / "_SUCCESS").unlink()
    found = artifacts.refreshed_artifact(spark.range(5), "id", {}, str(tmp_path / "a"), build)
    assert (found.built, found.rows.count()) == (5, 5)


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    from rankjobs.queries import sources

    bug = [(1, "red door\nstuck", "en", "web")]
    spark.createDataFrame(bug, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    order = "o_orderkey bigint, o_orderpriority string, o_orderstatus string, o_orderdate date"
    spark.createDataFrame([(1, "1-URGENT", "O", None)], order).write.parquet(f"{tmp_path}/orders.parquet")
    part = "p_partkey bigint, p_name string, p_brand string, p_type string"
    spark.createDataFrame([(5, "door", "b", "t")], part).write.parquet(f"{tmp_path}/part.parquet")
    line = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string"
    spark.createDataFrame([(1, 5, 1, "N")], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    turns = spark.createDataFrame([(7, 0, "red door"), (7, 1, "stuck")], "conv_id bigint, turn int, text string")
    turns.repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sources.stream_recommend(spark, str(tmp_path)).collect()
    assert sorted(r.query_id for r in found) == [700000, 700001]
