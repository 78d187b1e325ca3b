"""The link fact: from raw two-way links to one row per (bug, test case)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.functions.numeric import id_of
from rankjobs.sources import schemas
from rankjobs.sources.tables import require_columns

_MASTER = schemas.MASTER.fieldNames()
BUG_TEXT = tuple(_MASTER[1 : _MASTER.index("testcase_id")])
TESTCASE_TEXT = tuple(schemas.TESTCASES.fieldNames()[1:])
MASTER_TESTCASE_TEXT = tuple(_MASTER[_MASTER.index("testcase_id") + 1 :])


def clean_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``clean_html`` on those of the columns that exist."""
    return df.withColumns({c: tx.clean_html(c) for c in columns if c in df.columns})


def numeric_links(raw: DataFrame) -> DataFrame:
    """Raw links with both ends as ids; rows with an end that is no number are dropped."""
    require_columns(raw, schemas.RAW_LINKS.fieldNames(), "links")
    return raw.select(
        id_of(raw, "WorkItemId").alias("from_id"),
        id_of(raw, "LinkedWorkItemId").alias("to_id"),
        F.col("LinkedType").alias("link_type"),
    ).dropna(subset=["from_id", "to_id"])


def both_directions(raw: DataFrame) -> DataFrame:
    """Every link read as (bug, test case) once each way; which reading holds, the id sets decide."""
    ways = F.array(
        F.struct(F.col("from_id").alias("bug_id"), F.col("to_id").alias("testcase_id")),
        F.struct(F.col("to_id").alias("bug_id"), F.col("from_id").alias("testcase_id")),
    )
    return (
        numeric_links(raw)
        .select(F.explode(ways).alias("way"), "link_type")
        .select("way.bug_id", "way.testcase_id", "link_type")
    )


def resolve_links(raw: DataFrame, bugs: DataFrame, testcases: DataFrame, validate: bool = False) -> DataFrame:
    """Distinct ``(bug_id, testcase_id, link_type)`` whose two ends exist, in either raw direction.

    ``validate`` spends an action on raising ``ValueError`` when nothing is left.
    """
    bug_ids = bugs.select(id_of(bugs, "bug_id").alias("bug_id"))
    testcase_ids = testcases.select(id_of(testcases, "testcase_id").alias("testcase_id"))
    links = (
        both_directions(raw)
        .join(bug_ids, "bug_id", "left_semi")
        .join(testcase_ids, "testcase_id", "left_semi")
        .select("bug_id", "testcase_id", "link_type")
        .distinct()
    )
    if validate and links.isEmpty():
        raise ValueError("no link joins a known bug to a known test case")
    return links


def build_master(
    raw: DataFrame,
    bugs: DataFrame,
    testcases: DataFrame,
    *,
    unique_ids: bool = True,
    validate: bool = False,
) -> DataFrame:
    """The denormalised link table. Links that differ only in type fall together.

    The inner joins already drop dangling links, and the type is not part of the
    result, so the narrow pairs are made distinct before any wide column is
    attached. With ``unique_ids=False`` the two item tables may repeat rows; they
    are then made distinct first, which gives the same rows as doing it at the end.
    """
    require_columns(bugs, ("bug_id", *BUG_TEXT), "bugs")
    require_columns(testcases, ("testcase_id", *MASTER_TESTCASE_TEXT), "test cases")
    bug_side = bugs.select(id_of(bugs, "bug_id").alias("bug_id"), *BUG_TEXT)
    testcase_side = testcases.select(
        id_of(testcases, "testcase_id").alias("testcase_id"), *MASTER_TESTCASE_TEXT
    )
    if not unique_ids:
        bug_side, testcase_side = bug_side.distinct(), testcase_side.distinct()
    # narrow ids decide first, so that only pairs with both ends are made distinct
    master = (
        both_directions(raw)
        .select("bug_id", "testcase_id")
        .join(bug_side.select("bug_id"), "bug_id", "left_semi")
        .join(testcase_side.select("testcase_id"), "testcase_id", "left_semi")
        .distinct()
        .join(bug_side, "bug_id")
        .join(testcase_side, "testcase_id")
        .select(*schemas.MASTER.fieldNames())
    )
    if validate and master.isEmpty():
        raise ValueError("no link joins a known bug to a known test case")
    return master


def vote_links(master: DataFrame) -> DataFrame:
    """The narrow link table that voting needs."""
    return master.select("bug_id", "testcase_id", "testcase_title").distinct()


def unique_bugs(master: DataFrame) -> DataFrame:
    """One row per linked bug; the copies of a bug in the link table agree."""
    return (
        master.select("bug_id", *BUG_TEXT)
        .withColumn("bug_id", id_of(master, "bug_id"))
        .dropna(subset=["bug_id"])
        .dropDuplicates(["bug_id"])
    )


def dangling_links(raw: DataFrame, bugs: DataFrame, testcases: DataFrame) -> DataFrame:
    """Referential integrity in numbers: links kept, and links dropped for want of an end.

    A link is kept when one of its two readings has both ends. Every end is looked
    up once against the tagged ids of both tables, and the readings of a link are
    put together again by one aggregation on the pair.
    """
    links = (
        numeric_links(raw)
        .groupBy("from_id", "to_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = (
        bugs.select(id_of(bugs, "bug_id").alias("id"), F.lit(True).alias("is_bug"), F.lit(False).alias("is_testcase"))
        .unionByName(
            testcases.select(
                id_of(testcases, "testcase_id").alias("id"), F.lit(False).alias("is_bug"), F.lit(True).alias("is_testcase")
            )
        )
        .groupBy("id")
        .agg(F.bool_or("is_bug").alias("is_bug"), F.bool_or("is_testcase").alias("is_testcase"))
    )

    def end(name: str) -> DataFrame:
        return known.select(
            F.col("id").alias(f"{name}_id"),
            F.col("is_bug").alias(f"{name}_bug"),
            F.col("is_testcase").alias(f"{name}_testcase"),
        )

    tagged = links.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left").fillna(False)
    bug_end = F.col("from_bug") | F.col("to_bug")
    testcase_end = F.col("from_testcase") | F.col("to_testcase")
    kept = (F.col("from_bug") & F.col("to_testcase")) | (F.col("from_testcase") & F.col("to_bug"))
    return (
        tagged.select(
            "n",
            F.when(kept, "kept")
            .when(bug_end & testcase_end, "unpaired_ends")
            .when(bug_end, "no_testcase")
            .when(testcase_end, "no_bug")
            .otherwise("neither_end")
            .alias("status"),
        )
        .groupBy("status")
        .agg(F.sum("n").alias("links"))
    )
