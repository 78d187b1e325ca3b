"""Table schemas. Names and order of the columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


BUGS = T.StructType(
    [T.StructField("bug_id", T.LongType())]
    + _strings(
        "bug_title",
        "bug_description",
        "bug_tags",
        "priority",
        "severity",
        "area_path",
        "iteration_path",
        "state",
    )
)

TESTCASES = T.StructType(
    [T.StructField("testcase_id", T.LongType())]
    + _strings(
        "testcase_title",
        "testcase_description",
        "test_steps",
        "expected_results",
        "preconditions",
    )
)

RAW_LINKS = T.StructType(_strings("WorkItemId", "LinkedWorkItemId", "LinkedType"))

MASTER = T.StructType(
    [T.StructField("bug_id", T.LongType())]
    + _strings("bug_title", "bug_description", "bug_tags", "priority", "severity")
    + [T.StructField("testcase_id", T.LongType())]
    + _strings("testcase_title", "testcase_description", "test_steps")
)

WORK_ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
