"""K-d tree partitioning into shards of near equal size.

The rows are points in a space of metadata dimensions. A node that stands for n
leaves is cut along its widest dimension (width relative to that of all rows), where
the smaller half of its leaves gets its part of the bytes: the weighted median for an
even n. All nodes of a level are cut together: one aggregation gives the widths, then
``thresholds.cuts`` finds the medians with nested histograms. Rows never sort or meet.

A row's place along a dimension is 20 bits of its value in the node's range, then 20
bits of its text's hash, then 20 bits of its id's hash: equal values can be divided
where balance needs it, and equal texts lie side by side there.

Defined results: null texts have no bytes but ``ROW_BYTES``; a null in a dimension is
its smallest value; rows with equal text and id fall on one side; an empty table
gives an empty result. Column names of the input don't matter besides those named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.llm.thresholds import cuts, hashed_key, numbered
from rankjobs.sources.artifacts import stage

ROW_BYTES = 8
# rows of one block of slot numbers
BLOCK_BITS = 16


def document_dimensions(docs: DataFrame) -> dict[str, Column]:
    """The metadata of documents as far as the table has it: source and language (texts), size."""
    dimensions = {n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in ("source", "lang") if n in docs.columns}
    return dimensions | {"size": F.log1p(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double"))}


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    *,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per input row.

    ``shards`` leaves, or as many as ``target_bytes`` for each leaf ask for. Given
    ``dimensions`` are numbers; without them those of ``document_dimensions`` are taken,
    whose texts are numbered by the order of their distinct values.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    if dimensions is None:
        values = list(document_dimensions(docs).values())
    else:
        values = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in dimensions.values()]
    names = [f"d{i}" for i in range(len(values))]
    doc_id = F.col(f"`{id_column}`")
    row = F.monotonically_increasing_id()
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # rows equal in id and text are told apart by their places
        (F.shiftleft(F.shiftright(hashed_key(doc_id), 38), 10) + F.pmod(F.xxhash64(row), F.lit(1024))).alias("id_bits"),
        row.alias("row"),
        *(c.alias(n) for n, c in zip(names, values)),
    )
    for name in [n for n in names if rows.schema[n].dataType.typeName() == "string"]:
        places = stage(numbered(rows.select(name).distinct(), [F.col(name)], "place"), "kd-values")
        rows = rows.join(places, name).withColumn(name, F.col("place").cast("double")).drop("place")
    rows = stage(rows, "kd-rows")
    ranges = [F.max(n) - F.min(n) for n in names]
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.array(*ranges).alias("ranges")).first()
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("give shards or target_bytes")
        shards = max(1, math.ceil(whole["size"] / target_bytes))
    # a node is its first leaf and its number of leaves
    rows = rows.withColumns({"node": F.lit(0).cast("bigint"), "leaves": F.lit(shards).cast("bigint")})
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        rows = stage(_cut_level(rows, names, whole["ranges"]), "kd-level")
    return _slots(rows.select("doc_id", "size", "text_crc32", "row", F.col("node").cast("int").alias("shard")))


def _cut_level(rows: DataFrame, names: list[str], ranges: list[float]) -> DataFrame:
    """Every node of more than one leaf cut in two."""
    stats = rows.groupBy("node", "leaves").agg(
        F.sum("size").alias("bytes"),
        *(F.min(n).alias(f"{n}_low") for n in names),
        *(F.max(n).alias(f"{n}_high") for n in names),
    )
    widths = [
        F.struct(
            ((F.col(f"{n}_high") - F.col(f"{n}_low")) / (r if r else 1.0)).alias("width"),
            F.lit(-i).alias("first"),
            F.col(f"{n}_low").alias("low"),
            (F.col(f"{n}_high") - F.col(f"{n}_low")).alias("span"),
        )
        for i, (n, r) in enumerate(zip(names, ranges))
    ]
    nodes = stage(
        stats.filter(F.col("leaves") > 1)
        .withColumn("widest", F.greatest(*widths) if len(widths) > 1 else widths[0])
        .select(
            F.col("node").alias("g"),
            (-F.col("widest.first")).alias("dimension"),
            F.col("widest.low").alias("low"),
            F.col("widest.span").alias("span"),
            F.floor(F.col("leaves") / 2).alias("left_leaves"),
            (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("budget"),
        ),
        "kd-nodes",
    )
    value = F.element_at(F.array(*(F.col(n) for n in names)), F.col("dimension") + 1)
    place = F.when(F.col("span") > 0, F.floor((value - F.col("low")) / F.col("span") * ((1 << 20) - 1))).otherwise(0).cast("bigint")
    key = (
        F.shiftleft(place, 40)
        + F.shiftleft(F.pmod(F.hash("text_crc32").cast("bigint"), F.lit(1 << 20)), 20)
        + F.col("id_bits")
    )
    placed = rows.join(nodes, F.col("node") == F.col("g"), "left").withColumn("key", key)
    limits = cuts(
        placed.filter(F.col("leaves") > 1).select("g", "key", F.col("size").alias("weight")), nodes.select("g", "budget"), 60
    )
    cut = placed.join(limits, "g", "left")
    left = F.col("key") < F.col("cut")
    return cut.select(
        "doc_id", "size", "text_crc32", "id_bits", "row", *names,
        F.when(F.col("g").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("left_leaves")).alias("node"),
        F.when(F.col("g").isNull(), F.col("leaves"))
        .when(left, F.col("left_leaves"))
        .otherwise(F.col("leaves") - F.col("left_leaves"))
        .alias("leaves"),
    )


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers in each shard: places within blocks of rows, and the blocks' offsets."""
    rows = stage(rows.withColumn("block", F.shiftright("row", BLOCK_BITS)), "kd-shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    return (
        rows.withColumn("place", place)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("bigint").alias("slot"))
    )
