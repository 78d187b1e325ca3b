"""BM25 (Okapi): statistics, scores and exact top-k.

Scoring every text against every other one by a join of postings makes a row per
(query, item, shared term); a term that most texts contain makes nearly all pairs by
itself. Here postings stay inside their blocks. A task takes a query block and a
corpus block, multiplies the terms that fill much of the score matrix as dense
matrices, adds the sparse rest, some query rows at a time, and keeps the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.functions import text as tx
from rankjobs.functions.numeric import top_k
from rankjobs.operators import blocks
from rankjobs.sources.artifacts import stage

# The usual Okapi parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25

BLOCK = (
    "block_id bigint, ids array<bigint>, lengths array<int>, terms array<string>, doc_freq array<int>,"
    " post_term binary, post_doc binary, post_tf binary"
)
# Blocks that ask each other: terms are numbers in rising order, each with its postings' count and its idf.
NUMBERED = (
    "block_id bigint, ids array<bigint>, lengths array<int>, numbers binary, counts binary, idf binary, post_doc binary, post_tf binary"
)
# Postings are 32-bit numbers as bytes: readers of lists hold three numbers for each element.
POSTINGS = ("post_term", "post_doc", "post_tf")
# A long query can reach 10^5, where a double keeps ten decimals at best.
BM25_DECIMALS = 6
# A term is multiplied as a dense column when it fills 1/256 of the score matrix.
MAX_DENSE_TERMS = 1024
MAX_SPARSE_CHUNK = 1 << 18
# Query rows that sparse sums are made for at once, so that what they are added to stays in a core's cache.
SPARSE_ROWS = 32


def _block(number: int, ids, lengths, terms: pa.Array, term, doc, tf) -> pa.RecordBatch:
    """A block as a row; postings come sorted by term and text."""

    def one_list(values, kind) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def as_bytes(values) -> pa.Array:
        return pa.array([values.astype(np.int32).tobytes()], pa.binary())

    return pa.RecordBatch.from_arrays(
        [
            pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
            one_list(ids, pa.int64()),
            one_list(lengths.astype(np.int32), pa.int32()),
            one_list(terms.cast(pa.string()), pa.string()),
            one_list(np.bincount(term, minlength=len(terms)).astype(np.int32), pa.int32()),
            as_bytes(term),
            as_bytes(doc),
            as_bytes(tf),
        ],
        names=[part.split()[0] for part in BLOCK.split(", ")],
    )


def pack_texts(
    texts: DataFrame, id_column: str, text: Column | str, block_rows: int = 2048, block_tokens: int = 1 << 20
) -> DataFrame:
    """Token counts of texts in blocks, made where the rows are read: no shuffle.

    A block ends at ``block_rows`` texts or before ``block_tokens`` tokens, but holds
    any single text whole. Within a block texts are ordered by id, postings by term.
    """

    def emit(ids: np.ndarray, tokens: pa.Array, sizes: np.ndarray, number: int) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        coded = tokens.dictionary_encode()
        rows = place[np.repeat(np.arange(ids.size), sizes)]
        keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * ids.size + rows
        cells, tf = np.unique(keys, return_counts=True)
        return _block(number, ids[order], sizes[order], coded.dictionary, cells // ids.size, cells % ids.size, tf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        tokens: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        rows = held = number = 0

        def closed() -> pa.RecordBatch:
            return emit(np.concatenate(ids), pa.concat_arrays(tokens), np.concatenate(sizes), number)

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            start = 0
            while start < len(batch):
                base = ends[start - 1] if start else 0
                fit = int(np.searchsorted(ends, base + block_tokens - held, side="right")) - start
                take = min(fit, block_rows - rows, len(batch) - start)
                if take <= 0 and rows:
                    yield closed()
                    ids, tokens, sizes, rows, held, number = [], [], [], 0, 0, number + 1
                    continue
                take = max(1, take)
                part = batch.slice(start, take)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                tokens.append(part.column(1).flatten())
                sizes.append(lengths[start : start + take])
                rows, held, start = rows + take, held + int(sizes[-1].sum()), start + take
        if rows:
            yield closed()

    return texts.select(F.col(id_column).cast("bigint"), tx.tokenize(text)).mapInArrow(run, BLOCK)


def merged_blocks(packed: DataFrame, block_rows: int = 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """The texts of blocks in fuller blocks, from their postings alone; no shuffle.

    A block takes in the ones read after it up to ``block_rows`` texts and
    ``block_tokens`` tokens; one that is larger by itself stays as it is.
    """

    def emit(parts: list[dict], number: int) -> pa.RecordBatch:
        ids = np.concatenate([p["ids"] for p in parts])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        coded = pa.concat_arrays([p["terms"] for p in parts]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term_base = np.cumsum([0] + [len(p["terms"]) for p in parts])
        doc_base = np.cumsum([0] + [p["ids"].size for p in parts])
        term = codes[np.concatenate([p["post_term"] + base for p, base in zip(parts, term_base)])]
        doc = place[np.concatenate([p["post_doc"] + base for p, base in zip(parts, doc_base)])]
        by = np.lexsort((doc, term))
        tf, lengths = (np.concatenate([p[c] for p in parts]) for c in ("post_tf", "lengths"))
        return _block(number, ids[order], lengths[order], coded.dictionary, term[by], doc[by], tf[by])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows = tokens = number = 0
        for batch in batches:
            for i in range(len(batch)):
                part = {c: blocks.list_values(batch, c, i, np.int64) for c in ("ids", "lengths")}
                part |= {c: blocks.packed_values(batch, c, i, np.int64) for c in POSTINGS}
                part["terms"] = batch.column("terms")[i].values
                n, size = part["ids"].size, int(part["lengths"].sum())
                if held and (rows + n > block_rows or tokens + size > block_tokens):
                    yield emit(held, number)
                    held, rows, tokens, number = [], 0, 0, number + 1
                held.append(part)
                rows, tokens = rows + n, tokens + size
        if held:
            yield emit(held, number)

    return packed.select(*(part.split()[0] for part in BLOCK.split(", "))).mapInArrow(run, BLOCK)


@dataclass(frozen=True)
class Bm25Index:
    """Packed corpus, document frequencies, and three numbers."""

    blocks: DataFrame
    term_stats: DataFrame
    n_docs: int
    mean_length: float
    mean_idf: float

    def idf(self) -> DataFrame:
        """``(term, df, idf)``; a negative idf is replaced by a share of the mean idf."""
        raw = raw_idf(self.n_docs, F.col("df"))
        return self.term_stats.select("term", "df", F.when(raw < 0, F.lit(EPSILON * self.mean_idf)).otherwise(raw).alias("idf"))


def raw_idf(n_docs: int, df: Column) -> Column:
    return F.log(F.lit(float(n_docs)) - df + 0.5) - F.log(df + 0.5)


def term_frequencies(packed: DataFrame) -> DataFrame:
    """Texts per term. Each block brings one row per distinct term, so a term that all
    texts contain comes as one row per block."""
    return (
        packed.select(F.explode(F.arrays_zip("terms", "doc_freq")).alias("t"))
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum("t.doc_freq").alias("df"))
    )


def build_index(
    corpus: DataFrame, item_id: str = "bug_id", text: Column | str = "bug_text_enriched", block_rows: int = 2048
) -> Bm25Index:
    """Pack and stage the corpus, and count its terms. Three numbers come to the driver."""
    packed = stage(pack_texts(corpus, item_id, text, block_rows), "bm25-blocks")
    n, tokens = text_totals(packed)
    return index_of(packed, stage(term_frequencies(packed), "bm25-terms"), n, tokens)


def text_totals(packed: DataFrame) -> tuple[int, int]:
    """Number of texts, and of their tokens."""
    size = packed.agg(
        F.sum(F.size("ids")).alias("n"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"),
    ).first()
    return size.n or 0, size.tokens or 0


def index_of(packed: DataFrame, stats: DataFrame, n: int, tokens: int) -> Bm25Index:
    """An index of stored blocks and their stored ``(term, df)``."""
    # over the few distinct frequencies, and rounded: summing a value per term would
    # put noise into every score that depends on the order of the sum
    counted = stats.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    mean = counted.agg(F.sum(raw_idf(n, F.col("df")) * F.col("n")) / F.sum("n")).first()[0] if n else None
    return Bm25Index(packed, stats, n, tokens / n if n else 0.0, round(mean or 0.0, 12))


def statistics(index: Bm25Index) -> DataFrame:
    """Corpus numbers in one row, for reports."""
    return index.term_stats.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")).select(
        F.lit(index.n_docs).cast("bigint").alias("n_docs"),
        F.lit(index.mean_length).alias("mean_length"),
        F.lit(index.mean_idf).alias("mean_idf"),
        "terms",
        "postings",
    )


def _weighted_queries(packed: DataFrame, index: Bm25Index) -> DataFrame:
    """Query blocks with ``(place, idf)`` of those of their terms that the corpus has.

    Terms are looked up once per block, not once per text, so a common term does
    not gather a row per text in one task.
    """
    wanted = packed.select("block_id", F.posexplode("terms").alias("place", "term"))
    weights = (
        wanted.join(index.idf().select("term", "idf"), "term")
        .groupBy("block_id")
        .agg(F.collect_list(F.struct("place", "idf")).alias("idf"))
    )
    return packed.select("block_id", "ids", "terms", "post_term", "post_doc", "post_tf").join(weights, "block_id", "left")


def _numbered_blocks(index: Bm25Index, least: int) -> DataFrame:
    """The blocks of an index with numbers in place of their terms, without the terms of fewer than ``least`` texts.

    Two blocks are then matched by sorted numbers, where words have to be hashed anew for every pair of blocks.
    """
    columns = [part.split()[0] for part in NUMBERED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                term, doc, tf = (blocks.packed_values(batch, c, i, np.int32) for c in POSTINGS)
                known = batch.column("known")[i].values
                place, number, idf = (
                    np.empty(0, kind) if known is None else known.field(c).to_numpy(zero_copy_only=False)
                    for c, kind in (("place", np.int32), ("number", np.int64), ("idf", np.float64))
                )
                order = np.argsort(number)
                slot = np.full(max(place.max(initial=-1), term.max(initial=-1)) + 1, -1)
                slot[place[order]] = np.arange(order.size)
                kept = np.flatnonzero(slot[term] >= 0)
                kept = kept[np.argsort(slot[term[kept]], kind="stable")]
                counts = np.bincount(slot[term[kept]], minlength=order.size).astype(np.int32)
                values = (number[order].astype(np.int64), counts, idf[order].astype(np.float64), doc[kept], tf[kept])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, 1) for c in columns[:3]] + [pa.array([x.tobytes()], pa.binary()) for x in values],
                    names=columns,
                )

    numbers = index.idf().filter(F.col("df") >= least).select("term", "idf", F.monotonically_increasing_id().alias("number"))
    wanted = index.blocks.select("block_id", F.posexplode("terms").alias("place", "term"))
    known = (
        wanted.join(stage(numbers, "bm25-numbers"), "term")
        .groupBy("block_id")
        .agg(F.collect_list(F.struct("place", "number", "idf")).alias("known"))
    )
    whole = index.blocks.select("block_id", "ids", "lengths", *POSTINGS).join(known, "block_id", "left")
    return stage(whole.mapInArrow(run, NUMBERED), "bm25-numbered")


def _numbered_size(numbered: DataFrame) -> tuple[int, int, int]:
    """Number of blocks, an upper estimate of their bytes, and number of texts."""
    row = numbered.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("ids")).alias("texts"),
        F.sum(F.length("post_doc").cast("bigint") * 2 + F.size("ids") * 12 + F.length("counts") * 5).alias("bytes"),
    ).first()
    return row.n, row.bytes or 0, row.texts or 0


def packed_size(packed: DataFrame) -> tuple[int, int, int]:
    """Number of blocks, an upper estimate of their bytes, and number of texts."""
    row = packed.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("ids")).alias("texts"),
        F.sum(F.length("post_doc").cast("bigint") * 3 + F.size("ids") * 12 + F.size("terms") * 56).alias("bytes"),
    ).first()
    return row.n, row.bytes or 0, row.texts or 0


class TermScores:
    """Scores of the texts of two blocks over common term numbers, computed where they are wanted.

    Terms that fill much of the score matrix are multiplied as dense matrices, the sparse rest is added
    up posting by posting, some query rows at a time, so that what they are added to stays small. Products
    are in float32, off by at most ``share`` of a score where no weight is negative; ``exact`` makes the few
    pairs that it is asked for good in float64. Negative weights are multiplied in float64.

    Corpus postings of term ``t`` are the ``c_count[t]`` ones from ``c_first[t]`` on. ``own`` marks queries that
    the corpus block may hold too and whose own row is no candidate.
    """

    slack = 0.0

    def __init__(self, query_ids, q_term, q_doc, q_weight, item_ids, c_first, c_count, c_doc, c_weight, exclude_self: bool, fill_zero: bool):
        self.query_ids, self.item_ids, self.fill_zero = query_ids, item_ids, fill_zero
        self.own = np.isin(query_ids, item_ids) if exclude_self else np.zeros(query_ids.size, dtype=bool)
        rows, columns = query_ids.size, item_ids.size
        work = np.bincount(q_term, minlength=c_count.size) * c_count
        heavy = np.flatnonzero(work * 256 > rows * columns)
        heavy = heavy[np.argsort(-work[heavy], kind="stable")[:MAX_DENSE_TERMS]]
        slot = np.full(c_count.size, -1)
        slot[heavy] = np.arange(heavy.size)
        q_slot = slot[q_term]
        dense = np.flatnonzero(q_slot >= 0)
        self.left, self.right = np.zeros((rows, heavy.size)), np.zeros((columns, heavy.size))
        self.left[q_doc[dense], q_slot[dense]] = q_weight[dense]
        runs = c_count[heavy]
        met = _runs(c_first[heavy], runs)
        self.right[c_doc[met], np.repeat(np.arange(heavy.size), runs)] = c_weight[met]

        largest = q_weight.max(initial=0.0) * c_weight.max(initial=0.0)
        self.positive = bool(q_weight.min(initial=0.0) >= 0 and c_weight.min(initial=0.0) >= 0)
        narrow = self.positive and largest * (heavy.size + 1) < 1e30
        self.share = 1.01 * (heavy.size + 6) * 2.0**-24 if narrow else 0.0
        self.near_left, self.near_right = (x.astype(np.float32) if narrow else x for x in (self.left, self.right))

        light = np.flatnonzero((q_slot < 0) & (c_count[q_term] > 0))
        narrow = np.min_scalar_type(max(0, rows - 1))  # such numbers are sorted by digits
        light = light[np.argsort(q_doc[light].astype(narrow), kind="stable")]
        self.q_doc, self.q_weight = q_doc[light], q_weight[light]
        self.first, self.runs = c_first[q_term[light]], c_count[q_term[light]]
        self.ends = np.cumsum(self.runs)
        self.bounds = np.searchsorted(self.q_doc, np.arange(rows + 1))
        self.c_doc, self.c_weight = c_doc, c_weight

    def __len__(self) -> int:
        return self.query_ids.size

    def near(self, start: int, stop: int) -> np.ndarray:
        columns = self.item_ids.size
        self.products = self.near_left[start:stop] @ self.near_right.T
        scores = self.products.astype(np.float64)
        for first in range(start, stop, SPARSE_ROWS):
            last = min(first + SPARSE_ROWS, stop)
            flat = scores[first - start : last - start].reshape(-1)
            # each query posting meets the run of corpus postings of its term
            begin, end = self.bounds[first], self.bounds[last]
            while begin < end:
                done = self.ends[begin] - self.runs[begin]
                until = min(end, max(begin + 1, int(np.searchsorted(self.ends, done + MAX_SPARSE_CHUNK, side="right"))))
                part = slice(begin, until)
                runs = self.runs[part]
                met = _runs(self.first[part], runs)
                cells = np.repeat((self.q_doc[part] - first) * columns, runs)
                cells += self.c_doc[met]
                values = np.repeat(self.q_weight[part], runs)
                values *= self.c_weight[met]
                flat += np.bincount(cells, weights=values, minlength=flat.size)
                begin = until
        if not self.fill_zero and not self.positive:
            # rounded first, as the ranking sees it; without negative weights these are the last ones, and ``exact`` leaves them out
            flat = scores.reshape(-1)
            small = np.flatnonzero(np.abs(flat) < 10.0 ** (1 - BM25_DECIMALS))
            flat[small[np.round(flat[small], BM25_DECIMALS) == 0]] = -np.inf
        if self.own[start:stop].any():
            scores[self.query_ids[start:stop, None] == self.item_ids[None, :]] = -np.inf
        self.last = scores
        return scores

    def exact(self, start: int, stop: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Scores of the rows that ``near`` was asked for last."""
        out = self.last[rows, columns]
        if self.share:
            # many pairs, as of copies, cost less as one product
            if rows.size * 32 > (stop - start) * self.item_ids.size:
                out += (self.left[start:stop] @ self.right.T)[rows, columns] - self.products[rows, columns]
            else:
                left, right = self.left[start:stop], self.right
                for i in range(0, rows.size, blocks.PAIRS_AT_ONCE):
                    part = slice(i, i + blocks.PAIRS_AT_ONCE)
                    sums = np.einsum("ij,ij->i", left[rows[part]], right[columns[part]])
                    out[part] += sums - self.products[rows[part], columns[part]]
        if not self.fill_zero and self.positive:
            out[np.round(out, BM25_DECIMALS) == 0] = -np.inf
        return out


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all elements of runs, one run after the other."""
    ends = np.cumsum(sizes)
    numbers = np.repeat(first - (ends - sizes), sizes)
    numbers += np.arange(numbers.size)
    return numbers


def bm25_top_k(
    queries: DataFrame | None,
    index: Bm25Index,
    k: int,
    *,
    query_id: str = "query_id",
    text: Column | str = "query_text",
    exclude_self: bool = False,
    fill_zero: bool = False,
    block_rows: int = 2048,
) -> DataFrame:
    """The k best corpus rows of every query, exactly: ``query_id, bug_id, bm25_score, bm25_rank``.

    A query token counts as often as it occurs. ``queries=None`` takes the corpus
    itself as queries without packing it again. ``exclude_self`` leaves a query's own
    row out before the cut. ``fill_zero`` lets rows without a common term fill a list.
    """
    k = top_k(k)
    mean_length = index.mean_length or 1.0

    def packed(batch: pa.RecordBatch, name: str, i: int, dtype, kind=np.int32) -> np.ndarray:
        return blocks.packed_values(batch, name, i, dtype, kind)

    def matched_words(batch: pa.RecordBatch, i: int):
        """The term and the idf of query postings, and the run of corpus postings of each query term."""
        q_terms, c_terms = batch.column("q_terms")[i].values, batch.column("c_terms")[i].values
        number = pc.fill_null(pc.index_in(c_terms, value_set=q_terms), -1).to_numpy(zero_copy_only=False)
        shared = np.flatnonzero(number >= 0)
        sizes = np.bincount(packed(batch, "c_post_term", i, np.int32), minlength=number.size)
        known = batch.column("q_idf")[i].values
        idf = np.zeros(len(q_terms))
        if known is not None and len(known):
            idf[known.field("place").to_numpy(zero_copy_only=False)] = known.field("idf").to_numpy(zero_copy_only=False)
        return packed(batch, "q_post_term", i, np.int32), idf, number[shared], shared, sizes

    def matched_numbers(batch: pa.RecordBatch, i: int):
        q_numbers, c_numbers = (packed(batch, f"{side}_numbers", i, np.int64, np.int64) for side in "qc")
        at = np.searchsorted(q_numbers, c_numbers)
        shared = np.flatnonzero(np.r_[q_numbers, -1][at] == c_numbers)
        q_term = np.repeat(np.arange(q_numbers.size), packed(batch, "q_counts", i, np.int64))
        return q_term, packed(batch, "q_idf", i, np.float64, np.float64), at[shared], shared, packed(batch, "c_counts", i, np.int64)

    # the corpus asks itself by numbers; a text without company in its terms finds nothing by them
    match = matched_numbers if queries is None else matched_words

    def score(batch: pa.RecordBatch, i: int):
        query_ids, item_ids = (blocks.list_values(batch, c, i, np.int64) for c in ("q_ids", "c_ids"))
        q_term, idf, own, shared, sizes = match(batch, i)
        first, count = np.zeros(idf.size, dtype=np.int64), np.zeros(idf.size, dtype=np.int64)
        first[own], count[own] = (np.cumsum(sizes) - sizes)[shared], sizes[shared]
        c_doc, tf = packed(batch, "c_post_doc", i, np.int32), packed(batch, "c_post_tf", i, np.float64)
        dampen = K1 * (1 - B + B * blocks.list_values(batch, "c_lengths", i, np.float64) / mean_length)
        weight = tf * (K1 + 1) / (tf + dampen[c_doc])
        q_weight = packed(batch, "q_post_tf", i, np.float64) * idf[q_term]
        return query_ids, item_ids, TermScores(
            query_ids, q_term, packed(batch, "q_post_doc", i, np.int64), q_weight, item_ids, first, count, c_doc, weight, exclude_self, fill_zero
        )

    if queries is None:
        weighted = corpus = _numbered_blocks(index, 2 if exclude_self else 1)
        query_blocks, query_bytes, query_rows = _numbered_size(weighted)
    else:
        asked = stage(pack_texts(queries, query_id, text, block_rows), "bm25-queries")
        weighted = _weighted_queries(asked, index)
        corpus = index.blocks.select("block_id", "ids", "lengths", "terms", *POSTINGS)
        query_blocks, query_bytes, query_rows = packed_size(asked)
    found = blocks.search(
        weighted,
        corpus,
        query_blocks,
        max(1, index.blocks.count()),
        query_bytes,
        query_rows,
        lambda pairs: blocks.score_blocks(pairs, score, k, BM25_DECIMALS),
        k,
        "bm25_rank",
    )
    return found.select(
        "query_id", F.col("item_id").alias("bug_id"), F.col("score").alias("bm25_score"), "bm25_rank"
    )


def rerank_within(found: DataFrame, k: int) -> DataFrame:
    """Cut stored BM25 lists at a smaller k."""
    order = Window.partitionBy("query_id").orderBy("bm25_rank")
    return found.withColumn("bm25_rank", F.row_number().over(order)).filter(F.col("bm25_rank") <= top_k(k))
