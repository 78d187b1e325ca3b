"""Labelled rows for fitting: folds by the id's checksum, and a bounded sample of the learning fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 0 by 5; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learning_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(text, label, doc_id): at most ``rows_per_class`` rows of each class that are not held out.

    Which ones is decided by a hash of the id, so it does not depend on partitions. The
    bound is what makes it right to broadcast the ids and to collect the result. An id
    with several labels counts as 1 where most of them are. Ids that repeat in ``docs``
    bring the text of the smallest hash.
    """
    voted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.round(F.avg(label)).cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [voted.filter(F.col("label") == v).orderBy(*order).limit(rows_per_class) for v in (0, 1)]
    picked = picked[0].unionAll(picked[1])
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("row"))
    return found.select("doc_id", "row.text", "row.label")
