"""Data-quality counts and the validation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx


def _long_form(wide: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """One row per column out of a one-row frame."""
    return wide.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(value)) for c in columns))
        ).alias("cell")
    ).select("cell.column", f"cell.{value}")


def null_percentages(df: DataFrame) -> DataFrame:
    """Share of NULLs per column in percent, two decimals; one pass over the table."""
    wide = df.agg(
        *(
            F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 2).alias(c)
            for c in df.columns
        )
    )
    return _long_form(wide, df.columns, "null_pct")


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL or empty cells per column."""
    wide = df.agg(
        *(
            F.sum(F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), 1).otherwise(0)).alias(c)
            for c in df.columns
        )
    )
    return _long_form(wide, df.columns, "missing")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL or whitespace-only cells per column; a column that does not exist counts 0."""
    wide = df.agg(
        *(
            (F.sum(tx.is_blank(c).cast("bigint")) if c in df.columns else F.sum(F.lit(0))).alias(c)
            for c in columns
        )
    ).fillna(0)
    return _long_form(wide, columns, "blank")


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of their key, where NULL is a key of its own; no column gives 0.

    Counting per key first lets a key that holds a third of the rows shrink to one
    row per task before the shuffle.
    """
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit(column).alias("column"), F.lit(0).cast("bigint").alias("duplicates"))
    per_key = df.groupBy(F.col(f"`{column}`").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).select(
        F.lit(column).alias("column"), "duplicates"
    )


def section_report(df: DataFrame, section: str, keys: Sequence[str], blank: Sequence[str]) -> DataFrame:
    """One table's part of the validation report, long form.

    Everything but the duplicate counts comes from a single aggregation.
    """
    facts = {("rows", None): F.count(F.lit(1)).cast("double")}
    for c in blank:
        total = F.sum(tx.is_blank(c).cast("double")) if c in df.columns else F.lit(0.0)
        facts[("blank", c)] = F.coalesce(total, F.lit(0.0))
    for c in df.columns:
        facts[("null_pct", c)] = F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 2)
    wide = df.agg(*(value.alias(f"f{i}") for i, value in enumerate(facts.values())))
    cells = F.array(
        *(
            F.struct(
                F.lit(section).alias("section"),
                F.lit(metric).alias("metric"),
                F.lit(column).cast("string").alias("column"),
                F.col(f"f{i}").alias("value"),
            )
            for i, (metric, column) in enumerate(facts)
        )
    )
    report = wide.select(F.explode(cells).alias("c")).select("c.*")
    for key in keys:
        report = report.unionByName(
            duplicate_count(df, key).select(
                F.lit(section).alias("section"),
                F.lit("duplicates").alias("metric"),
                "column",
                F.col("duplicates").cast("double").alias("value"),
            )
        )
    return report


def validation_report(bugs: DataFrame, testcases: DataFrame, master: DataFrame) -> DataFrame:
    """The three-section quality report as ``(section, metric, column, value)``."""
    return (
        section_report(bugs, "bugs", ["bug_id"], ["bug_title", "bug_description"])
        .unionByName(
            section_report(testcases, "testcases", ["testcase_id"], ["testcase_title", "testcase_description"])
        )
        .unionByName(
            section_report(
                master,
                "master",
                ["bug_id", "testcase_id"],
                ["bug_title", "testcase_title", "bug_description", "testcase_description"],
            )
        )
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines, ready for a text sink."""
    value = F.when(F.col("metric") == "null_pct", F.format_string("%.2f", "value")).otherwise(
        F.col("value").cast("bigint").cast("string")
    )
    return report.orderBy("section", "metric", "column").select(
        F.concat_ws(" ", "section", "metric", "column", value).alias("value")
    )
