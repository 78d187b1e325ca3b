"""How the word use of sources differs from each other and from their language.

1. Terms of a text are runs of letters and characters beyond ASCII, with A-Z lower-cased.
   A first pass counts, per language, the documents that hold a term; tasks add up what
   they read before they send it. Terms of at least ``min_documents`` documents are kept.
2. Kept terms are dealt to shards by hash. Each shard gets a minimal perfect hash, built
   in a task of its own: levels of bits, a term's slot is the rank of its bit on the first
   level where it stands alone; terms that no level tells apart are listed. The terms
   themselves are stored in slot order, so that a strange word is recognised.
3. A second pass recounts. The hashes are broadcast; tasks look up the distinct words of a
   batch and add to dense arrays of slots, one for each source and shard. What is not zero
   leaves the task as (language, source, slot, count) and is summed by Spark.
4. Each shard, with the counts of all sources of its language, gives its part of every
   pair's divergence and its strongest terms per source; parts are summed and ranked.

Memory: a broadcast holds at most ``broadcast_bytes`` of hashes. If the kept terms need
more, they are taken in rounds, ordered by language; a round reads the documents of its
languages only. A task's dense arrays are sent off when they reach ``DENSE_BYTES``, its
document counts when they have ``HELD_TERMS`` terms. A shard has about SHARD_CELLS cells
(terms times sources of a language).

Defined results: null text, language and source count as ''; a source without terms and
a language without kept terms have rows in part ``pair`` with value 0 (of the latter) and
none in part ``term``; a language with one source has no pairs; equal values rank by
the item's bytes; repeated rows are documents of their own; an empty table gives an empty
result. Shares are exact for up to 4 * 10^15 words a language. Other columns do not matter.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.sources.artifacts import stage

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 14
SHARD_CELLS = 1 << 20
BROADCAST_BYTES = 64 << 20
DENSE_BYTES = 96 << 20
HELD_TERMS = 1 << 18
LEVELS = 32
SEED = 42

# bytes of UTF-8: A-Z to a-z, other ASCII to a space, the rest as it is
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

FREQUENCIES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])
HASHES = "lang string, shard int, n_terms bigint, hash binary"
CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])
PARTS = "lang string, source string, part string, item binary, value bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def digests_of(terms: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for the same bytes, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    """A hash of the digest for each level."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Terms to slots 0 .. n-1, each slot with its term."""

    words: list[np.ndarray] = field(default_factory=list)  # bits of a level
    ranks: list[np.ndarray] = field(default_factory=list)  # slots before each word
    keys: pa.Array | None = None
    listed: dict[bytes, int] = field(default_factory=dict)

    def packed(self) -> bytes:
        return pickle.dumps((self.words, self.ranks, self.keys, self.listed))

    @staticmethod
    def unpacked(data: bytes) -> PerfectHash:
        return PerfectHash(*pickle.loads(data))

    @staticmethod
    def build(terms: list[bytes], digests: np.ndarray) -> PerfectHash:
        out = PerfectHash()
        slots = np.empty(len(terms), dtype=np.int64)
        left, used = np.arange(len(terms)), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = 64 * (len(left) * 3 // 128 + 1)
            place = (_mixed(digests[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            before = np.cumsum(alone) - alone + used
            out.words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            out.ranks.append(before[::64].copy())
            good = alone[place]
            slots[left[good]] = before[place[good]]
            used += int(alone.sum())
            left = left[~good]
        for i, slot in zip(left, range(used, len(terms))):
            out.listed[terms[i]] = slot
            slots[i] = slot
        order = np.empty(len(terms), dtype=np.int64)
        order[slots] = np.arange(len(terms))
        out.keys = pa.array(terms, pa.binary()).take(pa.array(order))
        return out

    def slots_of(self, terms: list[bytes], digests: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for terms that are not stored."""
        slots = np.full(len(terms), -1, dtype=np.int64)
        left = np.arange(len(terms))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks)):
            place = _mixed(digests[left], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            found = words[word]
            hit = (found >> bit) & np.uint64(1) == 1
            lower = found[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slots[left[hit]] = ranks[word[hit]] + np.bitwise_count(lower)
            left = left[~hit]
        reached = np.flatnonzero(slots >= 0)
        if len(reached):
            stored = self.keys.take(pa.array(slots[reached]))
            same = pc.equal(stored, pa.array(terms, pa.binary()).take(pa.array(reached))).to_numpy(zero_copy_only=False)
            slots[reached[~same]] = -1
        if self.listed:
            for i in np.flatnonzero(slots < 0):
                slots[i] = self.listed.get(terms[i], -1)
        return slots


def _repeated(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            columns = [_repeated(lang, len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=FREQUENCIES)
        held.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts = held.setdefault(lang, Counter())
            before = len(counts)
            counts.update(set(terms_of(text)))
            size += len(counts) - before
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    terms = sorted(rows["term"])
    made = PerfectHash.build(terms, digests_of(terms))
    return pd.DataFrame(
        {"lang": [rows["lang"].iloc[0]], "shard": [rows["shard"].iloc[0]], "n_terms": [len(terms)], "hash": [made.packed()]}
    )


def _recount(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {key: PerfectHash.unpacked(made) for key, made in shared.value.items()}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), counts in dense.items():
                slots = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [_repeated(lang, len(slots)), _repeated(source, len(slots)), pa.array((shard << 32) | slots), pa.array(counts[slots])],
                    schema=CELLS,
                )
            dense.clear()

        def add(lang: str, source: str, words: Counter) -> int:
            terms, grown = list(words), 0
            digests, counts = digests_of(terms), np.fromiter(words.values(), np.int64, len(words))
            own = (digests & np.uint64(shards - 1)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                made = hashes.get((lang, int(own[part[0]])))
                if made is None:
                    continue
                slots = made.slots_of([terms[i] for i in part], digests[part])
                key = (lang, source, int(own[part[0]]))
                if key not in dense:
                    dense[key] = np.zeros(len(made.keys), dtype=np.int64)
                    grown += dense[key].nbytes
                dense[key][slots[slots >= 0]] += counts[part][slots >= 0]
            return grown

        size = 0
        for batch in batches:
            words: dict[tuple[str, str], Counter] = {}
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words.setdefault((lang, source), Counter()).update(terms_of(text))
            for (lang, source), counts in words.items():
                if counts:
                    size += add(lang, source, counts)
                if size > DENSE_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def shares(counts: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division in steps of 1000."""
    whole = np.asarray(total, dtype=np.int64) + 2 * terms
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _score(top: int):
    def run(rows: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
        own = rows["slot"] < 0
        marks = rows[own].sort_values("source")
        names, totals, n_terms = marks["source"].tolist(), marks["n"].to_numpy(), int(marks["n_terms"].iloc[0])
        lang = marks["lang"].iloc[0]
        keys = PerfectHash.unpacked(hashes["hash"].iloc[0]).keys.to_pylist() if len(hashes) else []
        cells = rows[~own]
        table = np.zeros((len(names), len(keys)), dtype=np.int64)
        places = cells["source"].map({name: i for i, name in enumerate(names)}).to_numpy(dtype=np.int64)
        table[places, cells["slot"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
        found: list[tuple] = []
        p = shares(table, totals[:, None], n_terms) if keys else table
        q = shares(table.sum(axis=0), totals.sum(), n_terms) if keys else table.sum(axis=0)
        for i, name in enumerate(names):
            sums = _gaps(p[i], p).sum(axis=1)
            found += [(lang, name, "pair", other.encode(), int(sums[j])) for j, other in enumerate(names) if j != i]
            more = np.flatnonzero((table[i] > 0) & (p[i] > q))
            values = _gaps(p[i][more], q[more])
            if len(more) > top:
                strong = values >= np.partition(values, len(values) - top)[len(values) - top]
                more, values = more[strong], values[strong]
            best = sorted(zip(-values, (keys[k] for k in more)))[:top]
            found += [(lang, name, "term", key, -int(value)) for value, key in best]
        return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])

    return run


def rounds_of(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int]]]:
    """(lang, shard, bytes) in the given order, cut so that a round has at most ``most`` bytes (or one shard)."""
    out, held = [], 0
    for lang, shard, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append((lang, shard))
        held += size
    return out


def divergences(
    docs: DataFrame,
    *,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
    shard_terms: int = SHARD_TERMS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_column}`"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_column}`"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"),
    )
    groups = stage(texts.select("lang", "source").distinct(), "groups")
    kept = stage(
        texts.select("lang", "text")
        .mapInArrow(_frequencies, "lang string, term binary, n bigint")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_documents)
        .select("lang", "term"),
        "kept-terms",
    )
    most_terms = kept.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    most_sources = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    shard_terms = max(64, min(shard_terms, SHARD_CELLS // most_sources))
    shards = 1 << max(0, (-(-most_terms // shard_terms) - 1)).bit_length()
    hashes = stage(
        kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
        .groupBy("lang", "shard")
        .applyInPandas(_build, HASHES),
        "perfect-hashes",
    )
    counts = _counted(spark, texts, hashes, shards, broadcast_bytes)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = hashes.groupBy("lang").agg(F.sum("n_terms").alias("n_terms"))
    marks = (
        groups.join(sums, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .join(hashes.select("lang", "shard"), "lang", "left")
        .select(
            "lang", F.coalesce("shard", F.lit(0)).alias("shard"), "source", F.lit(-1).alias("slot"),
            F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        )
    )
    cells = counts.select(
        "lang", F.shiftright("cell", 32).cast("int").alias("shard"), "source",
        F.col("cell").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("slot"), "n", F.lit(0).cast("bigint").alias("n_terms"),
    )
    parts = stage(
        cells.unionByName(marks)
        .groupBy("lang", "shard")
        .cogroup(hashes.groupBy("lang", "shard"))
        .applyInPandas(_score(top), PARTS),
        "divergence-parts",
    )
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order))

    terms = ranked(parts.filter("part = 'term'").select(*pairs.columns)).filter(F.col("rank") <= top)
    return ranked(pairs).unionByName(terms).withColumn("item", F.col("item").cast("string"))


def _counted(spark, texts: DataFrame, hashes: DataFrame, shards: int, broadcast_bytes: int) -> DataFrame:
    """lang, source, cell (shard and slot), n: occurrences of kept terms that are not zero."""
    sizes = hashes.select("lang", "shard", F.length("hash").alias("bytes")).orderBy("lang", "shard").collect()
    counted = []
    for wanted in rounds_of([tuple(r) for r in sizes], broadcast_bytes):
        langs = sorted({lang for lang, _ in wanted})
        (first_lang, first), (last_lang, last) = wanted[0], wanted[-1]
        at = F.struct("lang", "shard")
        part = hashes.filter(F.col("lang").isin(langs)).filter(
            at.between(F.struct(F.lit(first_lang), F.lit(first)), F.struct(F.lit(last_lang), F.lit(last)))
        )
        shared = spark.sparkContext.broadcast({(r["lang"], r["shard"]): bytes(r["hash"]) for r in part.collect()})
        cells = texts.filter(F.col("lang").isin(langs)).mapInArrow(_recount(shared, shards), "lang string, source string, cell bigint, n bigint")
        counted.append(stage(cells.groupBy("lang", "source", "cell").agg(F.sum("n").alias("n")), "cells"))
        shared.unpersist()
    if not counted:
        return spark.createDataFrame([], "lang string, source string, cell bigint, n bigint")
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out
