"""Budgets met by a threshold on a key, found with nested histograms instead of a sort.

Every row has a key of ``bits`` bits and a weight. For each group the smallest keys
whose weights sum up to a budget are wanted. A first histogram over the leading bits
shows the bucket in which the running sum passes the budget; only the rows of that
bucket are counted again over the next bits, and so on. A round shuffles one
pre-aggregated row per group, bucket and task; rows never are, and no group is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.sources.artifacts import stage

STEP = 12


def hashed_key(*parts: Column, bits: int = 48) -> Column:
    """The leading bits (a multiple of 4, 60 at most) of the MD5 of the parts; null parts count as empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint")


def cuts(rows: DataFrame, budgets: DataFrame, bits: int, step: int = STEP) -> DataFrame:
    """``budgets`` (g, budget) -> (g, cut): the rows of g with ``key < cut`` come nearest to the budget.

    ``rows`` has g (bigint), key (bigint, below 2^bits) and weight (bigint, not negative).
    Rows with one key fall on the same side. A budget that the whole group does not
    pass takes the group: its cut is 2^bits. A null budget counts as 0.
    """
    if bits % step:
        raise ValueError(f"bits {bits} must be a multiple of step {step}")
    rounds = bits // step
    state = budgets.select("g", F.coalesce("budget", F.lit(0.0)).alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    running = Window.partitionBy("g").orderBy("bucket")
    for r in range(rounds):
        shift = bits - step * (r + 1)
        inside = rows.join(state, "g")
        if r:
            inside = inside.filter(F.shiftright("key", shift + step) == F.col("prefix"))
        histogram = inside.groupBy("g", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("weight").alias("weight"), F.min("left").alias("left")
        )
        passed = histogram.withColumn("upto", F.sum("weight").over(running)).filter(F.col("upto") > F.col("left"))
        first = passed.groupBy("g").agg(
            F.min("bucket").alias("prefix"),
            # the running sum only grows, so the smallest values belong to the first bucket
            F.min("upto").alias("upto"),
            F.min(F.col("upto") - F.col("weight")).alias("before"),
            F.min("left").alias("old"),
        )
        last = r == rounds - 1
        state = stage(
            first.select(
                "g",
                (F.col("old") - F.col("before")).alias("left"),
                F.col("prefix") + (F.when(F.col("upto") - F.col("old") < F.col("old") - F.col("before"), 1).otherwise(0) if last else 0),
            ).toDF("g", "left", "prefix"),
            "cuts",
        )
    return budgets.select("g").join(state, "g", "left").select("g", F.coalesce("prefix", F.lit(1 << bits)).alias("cut"))


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Number the rows by ``order`` without a global sort in one task: ranges, counts of ranges, places in ranges."""
    ranges = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = stage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, place + F.col("_offset") + F.lit(start - 1)).drop("_range", "_offset")
