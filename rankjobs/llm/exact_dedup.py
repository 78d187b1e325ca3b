"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. One pass over the text gives each row a 64-bit fingerprint of its normalised text
   (white space runs are one space), its SHA-256, and the chunk of rows it is in.
   Only this narrow table is kept.
2. Each chunk sorts its distinct fingerprints. An owner holds an equal range of the
   fingerprint space; a chunk sends it the gaps between its fingerprints, Golomb-Rice
   coded: a quotient in unary, a remainder of fixed width. With b bits for the mean
   gap, a fingerprint costs about b + 2 bits instead of 64. A bit marks a fingerprint
   that more than one row of the chunk has.
3. Owners merge what they are sent and answer each chunk with a bitmap over its list:
   1 where the fingerprint is not unique.
4. The chunks read their bitmaps; rows with a 1 are suspects. Only suspects' texts are
   read again and grouped by their bytes. Copies meet in their task first, so a group
   with a third of all rows costs one row per task.
5. The groups go back to the suspect rows; all other rows are groups of their own.

Memory: a chunk has at most 2^20 rows, an owner about ``OWNER_ROWS`` fingerprints.
The set of fingerprints that select the suspects' texts is sent to every executor if
it has at most ``BROADCAST_ROWS`` entries of 8 bytes, which is counted; beyond that the
texts are shuffled by fingerprint and joined (a skewed fingerprint is split there).

Defined results: a null text is an empty text; of equal texts the smallest id stays,
null ids come last, and of rows with equal id exactly one stays; an empty table gives
an empty result. Column names of the input don't matter besides those named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.decisions import kept_rows
from rankjobs.sources.artifacts import stage

CHUNK_BITS = 20
OWNER_ROWS = 1 << 20
MIN_OWNERS = 64
BROADCAST_ROWS = 4 << 20
SPACES = r"[\x20\x09-\x0D]+"

SENT = "chunk bigint, low bigint, high bigint, owner int, n int, width int, gaps binary, repeated binary"
SENT_ARROW = pa.schema(
    [
        ("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()),
        ("width", pa.int32()), ("gaps", pa.binary()), ("repeated", pa.binary()),
    ]
)
BITMAPS = "chunk bigint, low bigint, high bigint, owner int, n int, bitmap binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned values -> width of the remainders, coded gaps (the first gap is the first value)."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values)
    width = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    # unary part: a 1 after as many 0 as the quotient says; then the remainders
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(width, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return width, np.packbits(np.concatenate([unary, remainders])).tobytes()


def golomb_decode(n: int, width: int, coded: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(coded, dtype=np.uint8))
    # the n-th 1 ends the unary part; quotients sum up to at most 2 n
    ends = np.flatnonzero(bits[: 4 * n + 2])[:n]
    if len(ends) < n:
        ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    remainders = bits[start : start + n * width].reshape(n, width).astype(np.uint64)
    gaps = quotients.astype(np.uint64) << np.uint64(width)
    if width:
        gaps += (remainders << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_starts(owners: int) -> np.ndarray:
    """The first fingerprint of each owner: equal parts of the 64-bit space."""
    return np.array([(o << 64) // owners for o in range(owners)], dtype=np.uint64)


def _send(owners: int):
    starts = _owner_starts(owners)

    def messages(chunk: int, rows: np.ndarray, fingerprints: np.ndarray) -> Iterator[dict]:
        values, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
        edges = np.append(np.searchsorted(values, starts), len(values))
        for owner in np.flatnonzero(np.diff(edges)):
            part = slice(edges[owner], edges[owner + 1])
            width, gaps = golomb_encode(values[part] - starts[owner])
            yield {
                "chunk": chunk, "low": int(rows[0]), "high": int(rows[-1]), "owner": int(owner),
                "n": int(edges[owner + 1] - edges[owner]), "width": width, "gaps": gaps,
                "repeated": np.packbits(counts[part] > 1).tobytes(),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads a chunk's rows in order; where the reader cuts a chunk, each part is a list of its own
        chunk, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, prints = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_pylist(list(messages(chunk, rows, prints)), schema=SENT_ARROW)
                held.clear()

        for batch in batches:
            chunks, rows, prints = (batch.column(c).to_numpy() for c in ("chunk", "row", "fingerprint"))
            edges = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(rows) != 1)) + 1), len(chunks)]
            for start, end in zip(edges, edges[1:]):
                if end > start:
                    if held and (chunks[start] != chunk or rows[start] != held[-1][0][-1] + 1):
                        yield from flush()
                    chunk = int(chunks[start])
                    held.append((rows[start:end], prints[start:end]))
        yield from flush()

    return run


def _answer(owners: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(n, w, g) for n, w, g in zip(group["n"], group["width"], group["gaps"])]
        repeated = [np.unpackbits(np.frombuffer(r, dtype=np.uint8))[: len(x)] for r, x in zip(group["repeated"], lists)]
        values, places, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        more = counts > 1
        np.logical_or.at(more, places, np.concatenate(repeated).astype(bool))
        bits = np.split(more[places], np.cumsum([len(x) for x in lists])[:-1])
        return group[["chunk", "low", "high", "owner", "n"]].assign(bitmap=[np.packbits(b).tobytes() for b in bits])

    return run


def _read_bitmaps(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    row, prints = rows["row"].to_numpy(), rows["fingerprint"].to_numpy()
    found = np.zeros(len(rows), dtype=bool)
    for (low, high), part in bitmaps.sort_values("owner").groupby(["low", "high"]):
        bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(part["bitmap"], part["n"])]
        own = slice(*np.searchsorted(row, [low, high + 1]))
        _, places = np.unique(prints[own].view(np.uint64), return_inverse=True)
        found[own] = np.concatenate(bits)[places].astype(bool)
    return rows[found][["row", "fingerprint"]]


def suspects(prints: DataFrame, owners: int) -> DataFrame:
    """(row, chunk, fingerprint) -> (row, fingerprint) of the rows whose fingerprint is not unique."""
    narrow = prints.select("row", "chunk", "fingerprint")
    sent = narrow.mapInArrow(_send(owners), SENT)
    bitmaps = sent.groupBy("owner").applyInPandas(_answer(owners), BITMAPS)
    return (
        narrow.groupBy("chunk").cogroup(bitmaps.groupBy("chunk")).applyInPandas(_read_bitmaps, "row bigint, fingerprint bigint")
    )


def exact_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    text = normalised(F.col(f"`{text_column}`"))
    row = F.monotonically_increasing_id()
    prints = stage(
        docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("normal")).select(
            "doc_id",
            row.alias("row"),
            F.shiftright(row, CHUNK_BITS).alias("chunk"),
            F.xxhash64("normal").alias("fingerprint"),
            F.sha2("normal", 256).alias("text_sha256"),
        ),
        "fingerprints",
    )
    owners = max(MIN_OWNERS, math.ceil(prints.count() / OWNER_ROWS))
    found = stage(suspects(prints, owners), "suspects")
    wanted = found.select("fingerprint").distinct()
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)

    # bytes decide: the texts themselves are the grouping key
    groups = (
        docs.select(text.alias("normal"), F.col(f"`{id_column}`").alias("doc_id"))
        .withColumn("fingerprint", F.xxhash64("normal"))
        .join(wanted, "fingerprint", "left_semi")
        .groupBy("normal")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("normal", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    marked = prints.join(found.select("row", F.lit(True).alias("suspect")), "row", "left")
    copies = stage(
        marked.filter("suspect").select("doc_id", "row", "text_sha256").join(groups, "text_sha256"), "copies"
    )
    # of rows that share the smallest id, the first
    first = (
        copies.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("text_sha256")
        .agg(F.min("row").alias("first_row"))
    )
    copies = copies.join(first, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("first_row")).alias("kept"), "text_sha256"
    )
    single = marked.filter(F.col("suspect").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return single.unionByName(copies)


def distinct_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input's rows without those whose text a kept row has; all columns stay as they are.

    Dropped rows are found by id and digest. Of rows with equal id and equal text one stays.
    """
    result = exact_duplicates(docs, id_column=id_column, text_column=text_column)
    sha = F.sha2(normalised(F.col(f"`{text_column}`")), 256)
    return kept_rows(docs, result.select("doc_id", F.col("text_sha256").alias("key"), "kept"), sha, id_column)
