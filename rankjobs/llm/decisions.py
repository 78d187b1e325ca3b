"""Apply decisions about rows to the documents they were made on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.sources.artifacts import stage

# The most dropped rows whose digests (16 bytes each) are sent to every executor.
BROADCAST_ROWS = 2 << 20


def kept_rows(
    docs: DataFrame, decisions: DataFrame, key: Column, id_column: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are.

    ``decisions`` has doc_id, key and kept, one row per document; ``key`` is the same key
    as an expression over the columns of ``docs``. Only dropped rows are looked up, by two
    hashes of id and key. Up to ``broadcast_rows`` of them, which is counted, they are broadcast
    and the documents stay where they are read; beyond that both sides are shuffled by hash.
    Where rows with equal id and key were kept and dropped, one of them stays.
    """

    def hashes(doc_id: Column, key: Column) -> list[Column]:
        null = doc_id.isNull()
        return [F.xxhash64(doc_id, key, null).alias("_h1"), F.xxhash64(F.lit(7), null, key, doc_id).alias("_h2")]

    both = ["_h1", "_h2"]
    own = hashes(F.col("doc_id"), F.col("key"))
    dropped = stage(decisions.filter("NOT kept").select(*own).distinct(), "dropped")
    few = dropped.count() <= broadcast_rows
    wanted = F.broadcast(dropped) if few else dropped
    twice = stage(decisions.filter("kept").select(*own).join(wanted, both, "left_semi"), "twice")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(*hashes(F.col(f"`{id_column}`"), key), row)
    back = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    stay = rows.join(wanted, both, "left_anti")
    if twice.isEmpty():
        return stay.select(*back)
    again = rows.join(F.broadcast(twice) if few else twice, both, "left_semi").dropDuplicates(both)
    return stay.unionByName(again).select(*back)
