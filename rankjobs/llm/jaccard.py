"""Join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Every text becomes a set of word n-gram hashes and ``HASHES`` MinHash values of it.
   Texts with equal sets are one class; its first row stands for it from here on.
2. Candidates are classes that agree in one of ``BANDS`` bands of four values. Only
   bands that more than one class has go on. At similarity 0.8 a pair misses all of
   24 bands with probability 3e-6.
3. In each band, values are compared in steps of 16. With a uniform prior and m matches
   in n values the similarity's posterior is Beta(m + 1, n - m + 1); when the probability
   that it is at least the threshold is below ``TOLERANCE``, the pair is dropped. What
   is left is written as stars (a class and the smallest one of its component), never as pairs.
4. The components of these stars are clusters. Their texts are read once more, and
   within a cluster all pairs meet in blocks: pruned again in the same way, then the
   sizes of intersections are counted exactly. Tasks return, for each class, the number
   of its partners, and the links' components as stars.
5. Components of the links are the near-duplicate groups.

Blocks hold about ``BLOCK`` classes of a band, ``TEXT_BLOCK`` texts of a cluster, so a large group is many
tasks of pairs of blocks and no task holds it whole. Exact copies cost one class.

Words are what white space separates, in lower case. A text of 1 to ``n - 1`` words has
one n-gram, all its words. Defined results: null and empty texts have no n-gram, no
partner, and are their own group; a document's links count every other row whose
similarity reaches the threshold, its copies too; rows with equal id are rows like any
other (a group is named by its smallest id, null ids come last); an empty table gives an
empty result. Column names of the input don't matter besides those named.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.decisions import kept_rows
from rankjobs.llm.graph import components
from rankjobs.sources.artifacts import stage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
TEXT_BLOCK = 256
BATCH_CHARS = 4 << 20
BROADCAST_ROWS = 1 << 20

_random = np.random.default_rng(20240501)
MULTIPLIERS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SETS = "row bigint, doc_id bigint, text_key bigint, set_key string, bands array<bigint>, values binary"
SETS_ARROW = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.string()),
        ("bands", pa.list_(pa.int64())), ("values", pa.binary()),
    ]
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts one after another, and where each text's begin (one more entry than texts)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    tokens = hashes[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[full]
    tokens = tokens[full]
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    # a sum with a factor per place; tokens beyond the end of a short text add nothing
    width = np.minimum(counts, words)
    grams = np.where(counts > 0, counts - width + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(firsts[-1]) - np.repeat(firsts[:-1], grams) + np.repeat(starts[:-1], grams)
    wide = np.repeat(width, grams)
    sums = np.zeros(len(at), np.uint64)
    for place in range(words):
        if len(at):
            inside = wide > place
            sums += np.where(inside, tokens[np.minimum(at + place, len(tokens) - 1)] * PLACES[place], np.uint64(0))
    return mixed(sums), firsts


def minhashes(grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32; the largest number where a text has no n-gram."""
    out = np.full((len(firsts) - 1, HASHES), np.uint32(0xFFFFFFFF))
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        starts = firsts[some]
        scratch = np.empty_like(grams)
        for h in range(HASHES):
            np.multiply(grams, MULTIPLIERS[h], out=scratch)
            scratch += ADDENDS[h]
            out[some, h] = np.minimum.reduceat(scratch, starts) >> np.uint64(32)
    return out


def _small_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some megabytes of text, so that the arrays of a step stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BATCH_CHARS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small_batches(whole):
                grams, firsts = ngram_sets(batch.column("text"), words)
                values = minhashes(grams, firsts)
                keys = [
                    hashlib.blake2b(np.unique(grams[a:b]).tobytes(), digest_size=16).hexdigest() if b > a else None
                    for a, b in zip(firsts, firsts[1:])
                ]
                bands = np.zeros((len(values), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands + values[:, r::ROWS].astype(np.uint64) + np.uint64(1))
                flat = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BANDS), flat),
                        pa.array([v.tobytes() for v in values.astype(np.uint16)], pa.binary()),
                    ],
                    schema=SETS_ARROW,
                )

    return run


def beta_tail(threshold: float, a: int, b: int) -> float:
    """P(x >= threshold) for x ~ Beta(a, b) with whole a and b, as a binomial sum."""
    n = a + b - 1
    return math.fsum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(a))


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed to stay) for each step."""
    return [
        (n, next(m for m in range(n + 1) if beta_tail(threshold, m + 1, n - m + 1) >= tolerance))
        for n in range(STEP, HASHES + 1, STEP)
    ]


def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list[tuple[int, int]]):
    """The pairs (i, j) of rows of two signature matrices that stay."""
    matches = np.zeros(len(i), np.int32)
    for n, least in steps:
        part = slice(n - STEP, n)
        matches += (left[i, part] == right[j, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 12


class Forest:
    """Components of the pairs seen so far, over nodes 0 to n - 1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            high, low = np.maximum(self.root[i], self.root[j]), np.minimum(self.root[i], self.root[j])
            apart = high != low
            i, j = i[apart], j[apart]
            # every root hooks onto a smaller one, so no circle can close
            np.minimum.at(self.root, high[apart], low[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def stars(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row number with the smallest one of its component, where that is another.

        Tasks that see the same component name the same edges, so these can be made distinct.
        """
        smallest = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(smallest, self.root, rows)
        smallest = smallest[self.root]
        apart = smallest != rows
        return rows[apart], smallest[apart]


def units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole units of rows that come ordered by ``unit``; small ones together, up to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("unit").to_numpy()
        changes = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and held[-1].column("unit")[-1].as_py() != ids[0]:
            changes = np.r_[0, changes]
        begin = 0
        for cut in changes.tolist():
            # a unit ends here; the rows held so far are whole units
            if sum(len(x) for x in held) + cut - begin >= rows:
                yield pa.Table.from_batches([*held, batch.slice(begin, cut - begin)])
                held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def pairs_of_units(unit: np.ndarray, block: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a unit (ordered by unit), some at a time.

    A unit of two blocks (``crossing``) has the pairs between them only.
    """
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.empty(0, np.int64)
    ends = np.repeat(np.r_[starts[1:], len(unit)], np.diff(np.r_[starts, len(unit)])) if len(unit) else starts
    after = ends - np.arange(len(unit)) - 1
    edges = np.searchsorted(np.cumsum(after), np.arange(PAIRS_AT_ONCE, after.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    start = 0
    for edge in edges.tolist():
        end = min(len(unit), edge + 1)
        n = after[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        keep = ~crossing[i] | (block[i] != block[j])
        yield i[keep], j[keep]
        start = end


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("values").to_pylist()), dtype=np.uint16).reshape(len(table), HASHES)


EDGES = "a bigint, b bigint"
EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS = "a bigint, b bigint, links bigint"
LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _forest_of_bands(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in units(batches, ROWS_AT_ONCE):
            row, unit, block, first, second = _columns(table, "row", "unit", "block", "first", "second")
            values = _signatures(table)
            forest = Forest(len(row))
            for i, j in pairs_of_units(unit, block, first != second):
                forest.add(*prune(values, values, i, j, steps))
            a, b = forest.stars(row)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES_ARROW)

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left[i] and right[j]."""
    if not len(i):
        return np.empty(0, np.int64)
    rows, columns = np.unique(i), np.unique(j)
    if len(rows) * len(columns) < 16 or len(i) * 8 < len(rows) * len(columns):
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    # many pairs: 0/1 matrices over the shared n-grams, a slab of them at a time
    a = np.concatenate([left[x] for x in rows])
    b = np.concatenate([right[y] for y in columns])
    shared = np.intersect1d(a, b)
    owners = (
        np.repeat(np.arange(len(rows)), [len(left[x]) for x in rows]),
        np.repeat(np.arange(len(columns)), [len(right[y]) for y in columns]),
    )
    total = np.zeros((len(rows), len(columns)), np.float32)
    slab = 4096
    places = []
    for grams, owner in zip((a, b), owners):
        at = np.searchsorted(shared, grams)
        known = at < len(shared)
        known[known] = shared[at[known]] == grams[known]
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], owner[known][order]))
    for start in range(0, len(shared), slab):
        matrices = []
        for (at, owner), n in zip(places, (len(rows), len(columns))):
            part = slice(*np.searchsorted(at, [start, start + slab]))
            m = np.zeros((n, slab), np.float32)
            m[owner[part], at[part] - start] = 1
            matrices.append(m)
        total += matrices[0] @ matrices[1].T
    return total[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.int64)


def _links_of_clusters(steps, words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in units(batches, 1):
            ids = several.column("unit").to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist()
            for start, end in zip(starts, [*starts[1:], len(ids)]):
                yield links(several.slice(start, end - start))

    def links(table: pa.Table) -> pa.RecordBatch:
        row, unit, block, first, second, copies = _columns(table, "row", "unit", "block", "first", "second", "copies")
        grams, firsts = ngram_sets(table.column("text").combine_chunks(), words)
        sets = [np.unique(grams[a:b]) for a, b in zip(firsts, firsts[1:])]
        sizes = np.array([len(s) for s in sets])
        values = _signatures(table)
        partners = np.zeros(len(row), np.int64)
        forest = Forest(len(row))
        for i, j in pairs_of_units(unit, block, first != second):
            i, j = prune(values, values, i, j, steps)
            shared = shared_counts(sets, sets, i, j)
            linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            i, j = i[linked], j[linked]
            np.add.at(partners, i, copies[j])
            np.add.at(partners, j, copies[i])
            forest.add(i, j)
        a, b = forest.stars(row)
        some = np.flatnonzero(partners)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([row[some], a])),
                pa.array(np.concatenate([row[some], b])),
                pa.array(np.concatenate([partners[some], np.zeros(len(a), np.int64)])),
            ],
            schema=LINKS_ARROW,
        )

    return run


def _in_units(rows: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Each row once per pair of blocks that its block is in; a group of at most ``block`` rows is one block."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        rows.withColumns({"blocks": blocks, "block": own})
        .withColumn("other", other)
        .withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        .withColumn("unit", F.xxhash64(group, "first", "second"))
        .drop("other", "blocks", count)
        .repartition("unit")
        .sortWithinPartitions("unit")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    text_block: int = TEXT_BLOCK,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """row, doc_id, text_key, class_id, class_size, n_links, kept: one row per input row."""
    steps = least_matches(threshold, tolerance)
    text = F.col(f"`{text_column}`")
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"),
    )
    sets = stage(source.mapInArrow(_describe(words), SETS), "jaccard-sets")
    classes = sets.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")
    )
    classes = stage(classes, "jaccard-classes")
    stands = sets.select("row", "text_key", "bands", "values").join(classes.select("row", "copies"), "row")
    stands = stage(stands, "jaccard-stands")

    # bands that more than one class has
    banded = stands.select("row", F.posexplode("bands").alias("band", "value")).select(
        "row", F.xxhash64("band", "value").alias("bucket")
    )
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    active = banded.join(crowded, "bucket").groupBy("row").agg(F.collect_list(F.struct("bucket", "members")).alias("buckets"))
    met = stands.select("row", "values").join(active, "row").select("row", "values", F.inline("buckets"))
    forest = _in_units(met, "bucket", "members", block).mapInArrow(_forest_of_bands(steps), EDGES)
    clusters = stage(components(forest), "jaccard-clusters")

    # whole texts of the clusters' classes, once each
    sized = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = stage(
        clusters.join(sized, "root").join(stands.select(F.col("row").alias("node"), "text_key", "values", "copies"), "node"),
        "jaccard-members",
    )
    wanted = members.select("text_key").distinct()
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = source.select("text_key", "text").join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    whole = members.withColumnRenamed("node", "row").join(texts, "text_key").select(
        "root", "members", "row", "values", "copies", "text"
    )
    found = stage(
        _in_units(whole, "root", "members", text_block).mapInArrow(_links_of_clusters(steps, words, threshold), LINKS),
        "jaccard-links",
    )
    groups = components(found.filter("a <> b").select("a", "b"))
    links = found.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    labelled = classes.join(links, "row", "left").join(groups.withColumnRenamed("node", "row"), "row", "left").select(
        "set_key", F.coalesce("root", "row").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = stage(
        sets.select("row", "doc_id", "text_key", "set_key")
        .join(labelled, "set_key", "left")
        .withColumn("root", F.coalesce("root", "row"))
        .drop("set_key"),
        "jaccard-rows",
    )
    best = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    firsts = (
        rows.join(best, "root").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("first"))
    )
    named = best.join(firsts, "root")
    return rows.join(named, "root").select(
        "row", "doc_id", "text_key", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("row") == F.col("first")).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The input's rows without near duplicates: of each group the row with the smallest id stays."""
    result = near_duplicates(docs, id_column=id_column, text_column=text_column, **settings)
    key = F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    return kept_rows(docs, result.select("doc_id", F.col("text_key").alias("key"), "kept"), key, id_column)
