"""Quality and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankjobs.operators import profile, quality
from rankjobs.plans import evaluate
from rankjobs.queries import model as m
from rankjobs.sources import schemas
from rankjobs.sources.artifacts import stage

BUG_COLUMNS = (*schemas.BUGS.fieldNames(), "created")
TESTCASE_COLUMNS = tuple(schemas.TESTCASES.fieldNames())
MASTER_COLUMNS = tuple(schemas.MASTER.fieldNames())
TEXT_COLUMNS = ("bug_title", "bug_description", "testcase_title", "testcase_description", "test_steps")


def null_pct(spark, sf):
    return quality.null_percentages(m.master(spark, sf))


def missing_counts(spark, sf):
    return quality.missing_counts(m.bugs(spark, sf).drop("created"))


def dup_counts(spark, sf):
    master = stage(m.master(spark, sf), "master")
    out = quality.duplicate_count(master, "bug_id")
    for column in ("testcase_id", "bug_title", "testcase_title", "no_such_column"):
        out = out.unionByName(quality.duplicate_count(master, column))
    return out


def blank_counts(spark, sf):
    return quality.blank_counts(m.bugs(spark, sf), ["bug_title", "bug_description", "no_such_column"])


def validation_report(spark, sf):
    # each table is read by several parts of the report
    tables = (m.bugs(spark, sf), m.testcases(spark, sf), m.master(spark, sf))
    return quality.validation_report(*(stage(t, "report") for t in tables))


def table_counts(spark, sf):
    return profile.table_counts(m.master(spark, sf), ["bug_id", "testcase_id"])


def degree_describe(spark, sf):
    links = m.vote_links(spark, sf)

    def side(name, key, other):
        d = profile.describe(profile.degrees(links, key, other), "degree")
        return d.select(F.lit(name).alias("side"), "count", *(F.round(c, 6).alias(c) for c in d.columns if c != "count"))

    return side("bugs_per_testcase", "testcase_id", "bug_id").unionByName(side("testcases_per_bug", "bug_id", "testcase_id"))


def degree_histogram(spark, sf):
    return profile.histogram(profile.degrees(m.vote_links(spark, sf), "testcase_id", "bug_id"), "degree", 50)


def long_tail(spark, sf):
    tail = profile.long_tail(profile.degrees(m.vote_links(spark, sf), "testcase_id", "bug_id"))
    return tail.withColumn("single_share", F.round("single_share", 6))


def top_testcases(spark, sf):
    return profile.top_rows(profile.degrees(m.vote_links(spark, sf), "testcase_id", "bug_id"), "degree", "testcase_id", 20)


def text_lengths(spark, sf):
    return profile.text_lengths(m.master(spark, sf), TEXT_COLUMNS)


def dup_titles(spark, sf):
    repeated = profile.repeated_values(m.testcases(spark, sf), "testcase_title")
    return profile.top_rows(repeated, "n", "testcase_title", 20)


def dup_bug_titles(spark, sf):
    return profile.repeated_values(m.bugs(spark, sf), "bug_title")


def value_counts(spark, sf):
    bugs = stage(m.bugs(spark, sf), "bugs")
    parts = [
        profile.value_counts(bugs, c, "value", missing="Missing").select(F.lit(c).alias("column"), "value", "n")
        for c in ("priority", "severity", "bug_tags", "state")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tag_frequency(spark, sf):
    return profile.tag_frequency(m.bugs(spark, sf))


def null_patterns(spark, sf):
    return profile.null_patterns(m.master(spark, sf))


def profile_summary(spark, sf):
    return profile.profile_summary(stage(m.master(spark, sf), "master"))


def time_split(spark, sf):
    before, after = evaluate.time_split(m.bugs(spark, sf).select("bug_id", "created"), "created", "1998-01-01")
    return before.select("bug_id", F.lit("train").alias("part")).unionByName(after.select("bug_id", F.lit("test").alias("part")))


def area_overlap(spark, sf):
    """Sources of bugs against groups of test cases; some have both, some one."""
    own = F.split("bug_tags", ";")[1]
    return profile.area_overlap(
        m.bugs(spark, sf), m.testcases(spark, sf), own, F.concat(F.lit("src"), (F.col("testcase_id") % 30).cast("string"))
    )


def cardinalities(spark, sf):
    return profile.cardinality(m.bugs(spark, sf), BUG_COLUMNS)


def _null_pct_sql(rel: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INT::DOUBLE) * 100, 2) AS null_pct FROM {rel}" for c in columns
    )


def _section_sql(section: str, rel: str, columns, keys, blank) -> str:
    def row(metric: str, column: str | None, value: str) -> str:
        name = "NULL" if column is None else f"'{column}'"
        return f"SELECT '{section}' AS section, '{metric}' AS metric, {name}::VARCHAR AS \"column\", ({value})::DOUBLE AS value FROM {rel}"

    rows = [row("rows", None, "count(*)")]
    rows += [row("blank", c, f"coalesce(sum(({m.sql_text(c)} = '')::INT), 0)") for c in blank]
    rows += [row("null_pct", c, f"round(avg(({c} IS NULL)::INT::DOUBLE) * 100, 2)") for c in columns]
    rows += [row("duplicates", c, f"count(*) - count(DISTINCT {c}) - (count(*) > count({c}))::INT") for c in keys]
    return " UNION ALL ".join(rows)


def _degree_sql(key: str, other: str) -> str:
    return f"SELECT {key}, count(DISTINCT {other}) AS degree FROM vote_links GROUP BY {key}"


def _describe_sql(name: str, rel: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont(degree, {p / 100}), 6) AS p{p}" for p in (25, 50, 75))
    return (
        f"SELECT '{name}' AS side, count(*) AS count, round(avg(degree), 6) AS mean, round(stddev_samp(degree), 6) AS std,"
        f" min(degree)::DOUBLE AS min, {quartiles}, max(degree)::DOUBLE AS max FROM {rel}"
    )


def _length_sql(c: str) -> str:
    length = f"length(coalesce({c}, ''))"
    return (
        f"SELECT '{c}' AS \"column\", round(avg({length}), 2) AS mean_length, median({length})::DOUBLE AS median_length,"
        f" round(quantile_cont({length}, 0.95), 2) AS p95_length, sum(({m.sql_text(c)} = '')::INT)::BIGINT AS blank_count FROM master"
    )


_DEGREES = {"per_testcase": _degree_sql("testcase_id", "bug_id"), "per_bug": _degree_sql("bug_id", "testcase_id")}

QUERIES = {
    "null_pct": (null_pct, m.with_ctes(("master",), {}, _null_pct_sql("master", MASTER_COLUMNS))),
    "missing_counts": (
        missing_counts,
        m.with_ctes(
            ("bugs",),
            {},
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", sum(({c} IS NULL OR {c}::VARCHAR = '')::INT)::BIGINT AS missing FROM bugs"
                for c in BUG_COLUMNS[:-1]
            ),
        ),
    ),
    "dup_counts": (
        dup_counts,
        m.with_ctes(
            ("master",),
            {},
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(*) - count(DISTINCT {c}) - (count(*) > count({c}))::BIGINT AS duplicates FROM master"
                for c in ("bug_id", "testcase_id", "bug_title", "testcase_title")
            )
            + " UNION ALL SELECT 'no_such_column', 0",
        ),
    ),
    "blank_counts": (
        blank_counts,
        m.with_ctes(
            ("bugs",),
            {},
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", sum(({m.sql_text(c)} = '')::INT)::BIGINT AS blank FROM bugs"
                for c in ("bug_title", "bug_description")
            )
            + " UNION ALL SELECT 'no_such_column', 0",
        ),
    ),
    "validation_report": (
        validation_report,
        m.with_ctes(
            ("bugs", "testcases", "master"),
            {},
            " UNION ALL ".join(
                (
                    _section_sql("bugs", "bugs", BUG_COLUMNS, ["bug_id"], ["bug_title", "bug_description"]),
                    _section_sql(
                        "testcases", "testcases", TESTCASE_COLUMNS, ["testcase_id"], ["testcase_title", "testcase_description"]
                    ),
                    _section_sql(
                        "master",
                        "master",
                        MASTER_COLUMNS,
                        ["bug_id", "testcase_id"],
                        ["bug_title", "testcase_title", "bug_description", "testcase_description"],
                    ),
                )
            ),
        ),
    ),
    "table_counts": (
        table_counts,
        m.with_ctes(
            ("master",),
            {},
            """SELECT 'rows' AS metric, count(*) AS value FROM master UNION ALL SELECT 'unique_bug_id', count(DISTINCT bug_id) FROM master
            UNION ALL SELECT 'unique_testcase_id', count(DISTINCT testcase_id) FROM master""",
        ),
    ),
    "degree_describe": (
        degree_describe,
        m.with_ctes(
            ("vote_links",),
            _DEGREES,
            _describe_sql("bugs_per_testcase", "per_testcase") + " UNION ALL " + _describe_sql("testcases_per_bug", "per_bug"),
        ),
    ),
    "degree_histogram": (
        degree_histogram,
        m.with_ctes(
            ("vote_links",),
            {
                **_DEGREES,
                "r": "SELECT min(degree)::DOUBLE AS lo, max(degree)::DOUBLE AS hi FROM per_testcase",
                "b": """SELECT CASE WHEN hi > lo THEN least(floor((degree - lo) / ((hi - lo) / 50)), 49) ELSE 0 END::INT AS bin,
                lo, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS w FROM per_testcase, r""",
            },
            "SELECT bin, round(lo + bin * w, 6) AS bin_start, count(*) AS n FROM b GROUP BY ALL",
        ),
    ),
    "long_tail": (
        long_tail,
        m.with_ctes(
            ("vote_links",),
            _DEGREES,
            """SELECT count(*) AS keys, sum((degree = 1)::INT)::BIGINT AS single, sum((degree = 2)::INT)::BIGINT AS double,
            round(avg((degree = 1)::INT::DOUBLE), 6) AS single_share FROM per_testcase""",
        ),
    ),
    "top_testcases": (
        top_testcases,
        m.with_ctes(("vote_links",), _DEGREES, "SELECT * FROM per_testcase ORDER BY degree DESC, testcase_id LIMIT 20"),
    ),
    "text_lengths": (text_lengths, m.with_ctes(("master",), {}, " UNION ALL ".join(map(_length_sql, TEXT_COLUMNS)))),
    "dup_titles": (
        dup_titles,
        m.with_ctes(
            ("testcases",),
            {},
            """SELECT testcase_title, count(*) AS n FROM testcases GROUP BY 1 HAVING count(*) > 1
            ORDER BY n DESC, testcase_title LIMIT 20""",
        ),
    ),
    "dup_bug_titles": (
        dup_bug_titles,
        m.with_ctes(
            ("bugs",), {}, "SELECT coalesce(bug_title, '') AS bug_title, count(*) AS n FROM bugs GROUP BY 1 HAVING count(*) > 1"
        ),
    ),
    "value_counts": (
        value_counts,
        m.with_ctes(
            ("bugs",),
            {},
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", coalesce({c}, 'Missing') AS value, count(*) AS n FROM bugs GROUP BY ALL"
                for c in ("priority", "severity", "bug_tags", "state")
            ),
        ),
    ),
    "tag_frequency": (
        tag_frequency,
        m.with_ctes(
            ("bugs",),
            {},
            """SELECT trim(tag) AS tag, count(*) AS n FROM (SELECT unnest(string_split(bug_tags, ';')) AS tag FROM bugs)
            WHERE trim(tag) <> '' GROUP BY ALL""",
        ),
    ),
    "null_patterns": (
        null_patterns,
        m.with_ctes(
            ("master",),
            {},
            "SELECT concat_ws(',', "
            + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in MASTER_COLUMNS)
            + ") AS missing, count(*) AS n FROM master GROUP BY 1",
        ),
    ),
    "profile_summary": (
        profile_summary,
        m.with_ctes(
            ("master", "vote_links"),
            _DEGREES,
            """SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM master
            UNION ALL SELECT 'unique_bug_id', count(DISTINCT bug_id) FROM master
            UNION ALL SELECT 'unique_testcase_id', count(DISTINCT testcase_id) FROM master
            UNION ALL SELECT 'single_testcases', sum((degree = 1)::INT) FROM per_testcase
            UNION ALL SELECT 'double_testcases', sum((degree = 2)::INT) FROM per_testcase
            UNION ALL SELECT 'single_share', round(avg((degree = 1)::INT::DOUBLE), 6) FROM per_testcase
            UNION ALL SELECT 'repeated_bug_title', count(*) FROM (SELECT 1 FROM master GROUP BY coalesce(bug_title, '') HAVING count(*) > 1)
            UNION ALL SELECT 'repeated_testcase_title', count(*) FROM (SELECT 1 FROM master GROUP BY coalesce(testcase_title, '') HAVING count(*) > 1)""",
        ),
    ),
    "time_split": (
        time_split,
        m.with_ctes(
            ("bugs",), {}, "SELECT bug_id, CASE WHEN created < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS part FROM bugs"
        ),
    ),
    "area_overlap": (
        area_overlap,
        m.with_ctes(
            ("bugs", "testcases"),
            {},
            """SELECT area, sum(b)::BIGINT AS bugs, sum(t)::BIGINT AS testcases FROM (
            SELECT trim(split_part(bug_tags, ';', 2)) AS area, 1 AS b, 0 AS t FROM bugs
            UNION ALL SELECT 'src' || (testcase_id % 30), 0, 1 FROM testcases) GROUP BY area""",
        ),
    ),
    "cardinalities": (
        cardinalities,
        m.with_ctes(
            ("bugs",),
            {},
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(*) FILTER ({c} IS NULL) AS missing FROM bugs"
                for c in BUG_COLUMNS
            ),
        ),
    ),
}
