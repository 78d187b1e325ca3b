"""The link fact and its integrity."""

from __future__ import annotations

from rankjobs.operators import cooccur, links
from rankjobs.queries import model as m


def _inputs(spark, sf):
    return m.raw_links(spark, sf), m.bugs(spark, sf), m.testcases(spark, sf)


def links_resolved(spark, sf):
    return links.resolve_links(*_inputs(spark, sf))


def master(spark, sf):
    return m.master(spark, sf)


def dangling_links(spark, sf):
    return links.dangling_links(*_inputs(spark, sf))


def vote_links(spark, sf):
    return m.vote_links(spark, sf)


def co_occurrence(spark, sf):
    return cooccur.co_occurrence(m.vote_links(spark, sf), 10)


def unique_bugs(spark, sf):
    return links.unique_bugs(m.master(spark, sf))


QUERIES = {
    "links_resolved": (links_resolved, m.with_ctes(("links",), {}, "SELECT * FROM links")),
    "master": (master, m.with_ctes(("master",), {}, "SELECT * FROM master")),
    "dangling_links": (
        dangling_links,
        m.with_ctes(
            ("bugs", "testcases", "raw_links"),
            {
                "ends": """SELECT from_id IN (SELECT bug_id FROM bugs) AS fb, to_id IN (SELECT bug_id FROM bugs) AS tb,
                from_id IN (SELECT testcase_id FROM testcases) AS ft, to_id IN (SELECT testcase_id FROM testcases) AS tt FROM raw_links"""
            },
            """SELECT CASE WHEN (fb AND tt) OR (ft AND tb) THEN 'kept' WHEN (fb OR tb) AND (ft OR tt) THEN 'unpaired_ends'
            WHEN fb OR tb THEN 'no_testcase' WHEN ft OR tt THEN 'no_bug' ELSE 'neither_end' END AS status, count(*) AS links
            FROM ends GROUP BY 1""",
        ),
    ),
    "vote_links": (vote_links, m.with_ctes(("vote_links",), {}, "SELECT * FROM vote_links")),
    "co_occurrence": (
        co_occurrence,
        m.with_ctes(
            ("vote_links",),
            {
                "pairs": """SELECT a.testcase_id, b.testcase_id AS other_testcase_id, count(*) AS bugs FROM (SELECT DISTINCT bug_id, testcase_id FROM vote_links) a
                JOIN (SELECT DISTINCT bug_id, testcase_id FROM vote_links) b ON a.bug_id = b.bug_id AND a.testcase_id <> b.testcase_id GROUP BY ALL"""
            },
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY testcase_id ORDER BY bugs DESC, other_testcase_id) AS rank FROM pairs)
            WHERE rank <= 10""",
        ),
    ),
    "unique_bugs": (
        unique_bugs,
        m.with_ctes(
            ("master",), {}, "SELECT DISTINCT bug_id, bug_title, bug_description, bug_tags, priority, severity FROM master"
        ),
    ),
}
