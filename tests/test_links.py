"""Link fact, quality and profile on hand-made rows."""

from __future__ import annotations

import pytest

from rankjobs.operators import links, profile, quality


@pytest.fixture()
def inputs(spark):
    raw = spark.createDataFrame(
        [
            ("1", "100", "Tests"),
            ("100", "1", "Tests"),
            ("1", "100", "Related"),
            ("1.0", "101", "Tests"),
            ("2", "999", "Tests"),
            ("888", "100", "Tests"),
            ("7", "8", "Tests"),
            ("1", "2", "Tests"),
            ("x", "100", "Tests"),
            (None, "100", "Tests"),
        ],
        "WorkItemId string, LinkedWorkItemId string, LinkedType string",
    )
    text = "bug_title string, bug_description string, bug_tags string, priority string, severity string"
    bugs = spark.createDataFrame([(1, "a", None, "t; u", "2.0", "1"), (2, "b", " ", None, None, None)], f"bug_id bigint, {text}")
    cases = spark.createDataFrame(
        [(100, "c", None, None), (101, "c", "d", "1. x")],
        "testcase_id bigint, testcase_title string, testcase_description string, test_steps string",
    )
    return raw, bugs, cases


def test_resolve_links(inputs):
    rows = sorted(map(tuple, links.resolve_links(*inputs).collect()))
    assert rows == [(1, 100, "Related"), (1, 100, "Tests"), (1, 101, "Tests")]


def test_master_collapses_link_types(inputs):
    rows = links.build_master(*inputs).orderBy("testcase_id").collect()
    assert [(r.bug_id, r.testcase_id, r.bug_title, r.test_steps) for r in rows] == [(1, 100, "a", None), (1, 101, "a", "1. x")]
    assert links.unique_bugs(links.build_master(*inputs)).count() == 1
    assert links.vote_links(links.build_master(*inputs)).count() == 2


def test_repeated_item_rows(inputs):
    raw, bugs, cases = inputs
    doubled = links.build_master(raw, bugs.union(bugs), cases.union(cases), unique_ids=False)
    assert doubled.count() == 2


def test_no_links_is_an_error_on_request(inputs):
    raw, bugs, cases = inputs
    empty = raw.filter("LinkedType = 'none'")
    assert links.resolve_links(empty, bugs, cases).count() == 0
    with pytest.raises(ValueError, match="no link joins"):
        links.resolve_links(empty, bugs, cases, validate=True)
    with pytest.raises(ValueError, match="no link joins"):
        links.build_master(empty, bugs, cases, validate=True)
    with pytest.raises(ValueError, match="missing required columns"):
        links.resolve_links(raw.drop("LinkedType"), bugs, cases)


def test_dangling_links(inputs):
    rows = {r.status: r.links for r in links.dangling_links(*inputs).collect()}
    assert rows == {"kept": 4, "no_testcase": 2, "no_bug": 1, "neither_end": 1}


def test_quality(spark, inputs):
    _, bugs, _ = inputs
    nulls = {r.column: r.null_pct for r in quality.null_percentages(bugs).collect()}
    assert nulls["bug_description"] == 50.0 and nulls["bug_id"] == 0.0
    blanks = {r.column: r.blank for r in quality.blank_counts(bugs, ["bug_description", "nope"]).collect()}
    assert blanks == {"bug_description": 2, "nope": 0}
    keyed = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k bigint")
    assert quality.duplicate_count(keyed, "k").first().duplicates == 2
    assert quality.duplicate_count(keyed, "nope").first().duplicates == 0
    assert {r.column: r.missing for r in quality.missing_counts(bugs).collect()}["severity"] == 1


def test_report(inputs):
    raw, bugs, cases = inputs
    report = quality.validation_report(bugs, cases, links.build_master(raw, bugs, cases))
    values = {(r.section, r.metric, r.column): r.value for r in report.collect()}
    assert values["bugs", "rows", None] == 2
    assert values["master", "duplicates", "bug_id"] == 1
    assert values["bugs", "blank", "bug_description"] == 2
    assert "bugs rows 2" in [r.value for r in quality.report_lines(report).collect()]


def test_profile(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 10), (2, 10), (3, 10), (3, 11), (None, 12)], "b bigint, t bigint")
    degree = profile.degrees(pairs, "t", "b")
    assert {r.t: r.degree for r in degree.collect()} == {10: 3, 11: 1}
    row = profile.describe(degree, "degree").first()
    assert (row["count"], row["mean"], row["min"], row["p25"], row["p50"], row["max"]) == (2, 2.0, 1.0, 1.5, 2.0, 3.0)
    assert row["std"] == pytest.approx(2**0.5)
    tail = profile.long_tail(degree).first()
    assert (tail["keys"], tail["single"], tail["double"], tail["single_share"]) == (2, 1, 0, 0.5)
    bins = {r["bin"]: r["n"] for r in profile.histogram(degree, "degree", 4).collect()}
    assert bins == {0: 1, 3: 1}
    same = spark.createDataFrame([(5,), (5,)], "degree bigint")
    assert [tuple(r) for r in profile.histogram(same, "degree", 4).select("bin", "n").collect()] == [(0, 2)]
    tags = spark.createDataFrame([("a; b",), ("a;",), (None,)], "bug_tags string")
    assert {r.tag: r.n for r in profile.tag_frequency(tags).collect()} == {"a": 2, "b": 1}
    assert {r.v: r.n for r in profile.value_counts(tags, "bug_tags", "v", missing="Missing").collect()}["Missing"] == 1
    lengths = profile.text_lengths(spark.createDataFrame([("ab",), (None,), (" ",)], "x string"), ["x"]).first()
    assert (lengths.mean_length, lengths.median_length, lengths.blank_count) == (1.0, 1.0, 2)
    patterns = {r.missing: r.n for r in profile.null_patterns(pairs).collect()}
    assert patterns == {"": 5, "b": 1}
