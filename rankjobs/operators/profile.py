"""Exploratory profile of the link fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx


def table_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count and distinct non-NULL keys, long form."""
    rows = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows").alias("metric"), "value")
    for key in keys:
        distinct = df.select(key).filter(F.col(key).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("value"))
        rows = rows.unionByName(distinct.select(F.lit(f"unique_{key}").alias("metric"), "value"))
    return rows


def degrees(links: DataFrame, key: str, other: str) -> DataFrame:
    """Distinct partners per key. Pairs are made distinct first, which spreads a hot key."""
    pairs = links.select(key, other).dropna().distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max, quartiles interpolated.

    Values are counted first: the exact percentile then holds one entry per
    distinct value, not per row.
    """
    counted = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null")
    n, s = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    # the mean comes first, as a scalar subquery: sums of squares of large values lose their difference
    mean = counted.agg((s / n).alias("mean")).scalar()
    away = F.col("v") - mean
    first = counted.agg(
        n.alias("count"),
        (s / n).alias("mean"),
        F.sum(away * away * F.col("n")).alias("_squares"),
        F.min("v").alias("min"),
        quartiles.alias("q"),
        F.max("v").alias("max"),
    )
    return first.select(
        "count",
        "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1))).alias("std"),
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, the last one closed.

    The two ends of the range come to the driver, the values do not.
    """
    counted = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null")
    low, high = counted.agg(F.min("v"), F.max("v")).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    bin_no = F.least(F.floor((F.col("v") - F.lit(low)) / width), F.lit(bins - 1))
    return (
        counted.groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
        .withColumn("bin_start", F.round(F.lit(low) + F.col("bin") * width, 6))
    )


def long_tail(degree: DataFrame) -> DataFrame:
    """How many keys have one partner, two partners, any, and the share of the single ones."""
    return degree.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum((F.col("degree") == 1).cast("bigint")).alias("single"),
        F.sum((F.col("degree") == 2).cast("bigint")).alias("double"),
        F.avg((F.col("degree") == 1).cast("double")).alias("single_share"),
    )


def top_rows(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n largest, equal ones by key."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key).asc()).limit(n)


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median and 95th percentile of the length in characters, and blank cells, per column."""
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.length(F.coalesce(F.col(c), F.lit(""))).alias("chars"),
                tx.is_blank(c).cast("bigint").alias("blank"),
            )
            for c in columns
        )
    )
    # only (column, length) pairs are shuffled, already counted
    counted = (
        df.select(F.explode(cells).alias("c"))
        .groupBy("c.column", "c.chars")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c.blank").alias("blank"))
    )
    return counted.groupBy("column").agg(
        F.round(F.sum(F.col("chars") * F.col("n")) / F.sum("n"), 2).alias("mean_length"),
        F.percentile("chars", F.lit(0.5), F.col("n")).alias("median_length"),
        F.round(F.percentile("chars", F.lit(0.95), F.col("n")), 2).alias("p95_length"),
        F.sum("blank").alias("blank_count"),
    )


def value_counts(df: DataFrame, value: Column | str, name: str = "value", missing: str | None = None) -> DataFrame:
    """Rows per value; NULL is left out, or counted under ``missing``."""
    value = tx.as_col(value)
    value = F.coalesce(value, F.lit(missing)) if missing is not None else value
    return df.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, NULL read as the empty text."""
    return value_counts(df, column, column, missing="").filter("n > 1")


def tag_frequency(df: DataFrame, column: str = "bug_tags", separator: str = ";") -> DataFrame:
    """Rows per single tag."""
    tags = F.explode(F.transform(F.split(F.col(column), separator), tx.strip))
    return df.select(tags.alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def null_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing columns, named in column order."""
    flags = F.array_compact(
        F.array(*(F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns))
    )
    return df.select(F.array_join(flags, ",").alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def area_overlap(bugs: DataFrame, testcases: DataFrame, bug_area: Column | str, testcase_area: Column | str) -> DataFrame:
    """Bugs and test cases per area (planned in the specification, not in its code)."""
    one, none = F.lit(1), F.lit(0)
    rows = bugs.select(tx.strip(bug_area).alias("area"), one.alias("b"), none.alias("t")).unionByName(
        testcases.select(tx.strip(testcase_area).alias("area"), none.alias("b"), one.alias("t"))
    )
    return rows.groupBy("area").agg(F.sum("b").alias("bugs"), F.sum("t").alias("testcases"))


def area_overlap_levels(
    bugs: DataFrame, testcases: DataFrame, bug_area: Column | str, testcase_area: Column | str, separator: str = "\\"
) -> DataFrame:
    """Bugs and test cases in every area and all that it lies in: ``level, area, bugs, testcases``.

    Level 0 is the root, which holds all rows, also those without a path. Equal paths are
    counted before they are taken apart, so a hot path costs one row per task.
    """
    one, none = F.lit(1), F.lit(0)
    rows = bugs.select(tx.as_col(bug_area).alias("path"), one.alias("b"), none.alias("t")).unionByName(
        testcases.select(tx.as_col(testcase_area).alias("path"), none.alias("b"), one.alias("t"))
    )
    counted = rows.groupBy("path").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    return (
        counted.select(F.explode(tx.path_prefixes("path", separator)).alias("p"), "b", "t")
        .groupBy("p.level", "p.area")
        .agg(F.sum("b").alias("bugs"), F.sum("t").alias("testcases"))
    )


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and missing cells of each column, in one pass: cells are counted before they meet."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    counted = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(
        F.count("value").alias("distinct_values"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing")
    )


def profile_summary(master: DataFrame) -> DataFrame:
    """The headline numbers of the profile as ``(metric, value)``."""
    counts = table_counts(master, ["bug_id", "testcase_id"]).select("metric", F.col("value").cast("double").alias("value"))
    tail = long_tail(degrees(master, "testcase_id", "bug_id")).select(
        F.explode(
            F.array(
                F.struct(F.lit("single_testcases").alias("metric"), F.col("single").cast("double").alias("value")),
                F.struct(F.lit("double_testcases").alias("metric"), F.col("double").cast("double").alias("value")),
                F.struct(F.lit("single_share").alias("metric"), F.round("single_share", 6).alias("value")),
            )
        ).alias("c")
    ).select("c.*")
    report = counts.unionByName(tail)
    for column in ("bug_title", "testcase_title"):
        repeated = repeated_values(master, column).agg(F.count(F.lit(1)).cast("double").alias("value"))
        report = report.unionByName(repeated.select(F.lit(f"repeated_{column}").alias("metric"), "value"))
    return report
