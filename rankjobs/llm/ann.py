"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is rotated by a random orthogonal matrix; its code is the sign bits, with
one scalar: the inner product of the rotated vector and the unit vector its signs stand
for. A rotated unit query is rounded to ``2 ** PLANES`` even levels, and its inner product with
the signs is counted from packed bits: the weighted number of common bits of the code and
each bit plane of the levels. That, divided by the scalar, is the estimate, without bias; with
probability growing fast in ``EPSILON`` the error is at most EPSILON times
sqrt((1 - scalar^2) / scalar^2 / (D - 1)) plus the deviation that the rounding adds. A
candidate is reranked with its original vector if its estimate plus that bound reaches
the k-th best exact score so far.

So that there is such a score from the start, every query is first searched in a sample of
about ``SEED_ROWS`` candidates picked by a hash; its k-th best score there is a floor that
the k-th best of all candidates cannot be under. The sample decides no result.

Queries and candidates meet in units of a grid: a group of queries is held in memory, the
candidates of a shard stream past them. A unit returns at most k rows a query. Units are
dealt by hashes of row numbers, so copies of a vector spread evenly. There is no coarse
index: every query is estimated against every code.

Defined results: rows with a null id, and vectors that are null, zero, or hold null or not
finite components, take no part; vectors are searched among those of their own length,
since others have no cosine with them; equal scores go by the smaller id; a row is no
candidate of its own query, but other rows with its id are; an empty table gives an empty
result. Ids that are no integers fail the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.sources.artifacts import stage

EPSILON = 3.0
PLANES = 6
SEED_ROWS = 8192
SEED_QUERIES = 1024
# Queries of a unit: as many as these elements make, within the two bounds.
QUERY_ELEMENTS = 1 << 22
FEWEST_QUERIES, MOST_QUERIES = 256, 16_384
SHARD_ROWS = 1 << 20
LEAST_UNITS = 64
PAIRS_AT_ONCE = 1 << 21
RERANKED_AT_ONCE = 1 << 16

CODED = "row bigint, vec_id bigint, dimension int, vector binary, code binary, scalar double"
CODED_ARROW = pa.schema(
    [
        ("row", pa.int64()), ("vec_id", pa.int64()), ("dimension", pa.int32()), ("vector", pa.binary()), ("code", pa.binary()),
        ("scalar", pa.float64()),
    ]
)
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score double"
FOUND_ARROW = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@lru_cache(maxsize=8)
def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, packed sign bits, scalars."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / largest
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotated = unit @ turn
    bits = rotated >= 0
    scalars = np.abs(rotated).sum(axis=1) / math.sqrt(vectors.shape[1])
    return rotated, np.packbits(bits, axis=1), scalars


def _in_range(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, scaled by a power of two; all others as they are."""
    largest = np.abs(x).max(axis=1, initial=0.0)
    odd = (largest > 1e150) | (largest < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(largest[odd])[1][:, None])
    return x


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision."""
    a, b = _in_range(a), _in_range(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors from their bytes, which are those of floats or doubles, as doubles."""
    rows = column.to_pylist()
    kind = np.float32 if len(rows[0]) == 4 * dimension else np.float64
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), dimension).astype(np.float64)


def words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, filled up with zeros."""
    filled = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    filled[:, : bits.shape[1]] = bits
    return filled.view(np.uint64)


def _code(kind: type):
    def coded(batch: pa.RecordBatch, dimension: int) -> pa.RecordBatch:
        vectors = np.asarray(batch.column("vector").flatten(), dtype=np.float64).reshape(len(batch), dimension)
        _, codes, scalars = encode(vectors, rotation(dimension))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("vec_id"), pa.array(np.full(len(batch), dimension, dtype=np.int32)),
                pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(scalars),
            ],
            schema=CODED_ARROW,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            for length in np.unique(lengths):
                yield coded(batch.filter(pa.array(lengths == length)), int(length))

    return run


class Levels:
    """Rotated unit queries on even levels, as bit planes that meet packed codes."""

    def __init__(self, rotated: np.ndarray):
        d = rotated.shape[1]
        self.low = rotated.min(axis=1)
        step = (rotated.max(axis=1) - self.low) / (2**PLANES - 1)
        self.step = np.where(step > 0, step, 1.0)
        levels = np.rint((rotated - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [words(np.packbits((levels >> b) & 1, axis=1)) for b in range(PLANES)]
        self.total = self.low * d + self.step * levels.sum(axis=1)
        self.root = math.sqrt(d)
        # a level is off by a twelfth of a squared step on average, with a sign that the rotation makes random
        self.deviation = self.step / math.sqrt(12)

    def estimate(self, codes: np.ndarray, scalars: np.ndarray) -> np.ndarray:
        """The inner product of every query with every coded unit vector."""
        common = np.zeros((len(self.low), len(codes)), dtype=np.float32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * np.float32(1 << b)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64).astype(np.float32)
        common *= (2 * self.step).astype(np.float32)[:, None]
        common += np.outer((2 * self.low).astype(np.float32), ones)
        common -= self.total.astype(np.float32)[:, None]
        common /= (self.root * scalars).astype(np.float32)
        return common

    def bound(self, scalars: np.ndarray, epsilon: float) -> np.ndarray:
        """What an estimate is off by at most, but for a probability that falls fast in ``epsilon``."""
        d = self.root * self.root
        spread = np.sqrt(np.maximum(0, 1 - scalars**2) / max(1, d - 1)) / scalars
        bound = np.outer(self.deviation.astype(np.float32), (1 / scalars).astype(np.float32))
        bound += spread.astype(np.float32)
        bound *= np.float32(epsilon)
        return bound


class Search:
    """The k best of one group of queries over the candidates that stream past."""

    def __init__(self, rows, ids, floors, vectors, k, epsilon):
        self.rows, self.ids, self.floors, self.vectors, self.k, self.epsilon = rows, ids, floors, vectors, k, epsilon
        self.levels = Levels(encode(vectors, rotation(vectors.shape[1]))[0])
        self.unit = self._unit(vectors)
        self.scores = np.full((len(rows), k), -np.inf)
        self.best = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.place = {row: i for i, row in enumerate(rows.tolist())}

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)

    def least(self) -> np.ndarray:
        """The score that each query's candidates must reach."""
        return np.maximum(self.scores[:, -1], self.floors)

    def see(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> None:
        upper = self.levels.estimate(codes, scalars)
        own = [(self.place[row], j) for j, row in enumerate(rows.tolist()) if row in self.place]
        if own:
            upper[tuple(np.array(own).T)] = -np.inf
        unit = self._unit(vectors)
        bare = np.flatnonzero(np.isneginf(self.least()))
        if len(bare) and len(rows) > self.k + 1:
            # start with the likeliest, so that the bound has something to be compared with
            start = np.argpartition(-upper[bare], self.k, axis=1)[:, : self.k]
            i, j = np.repeat(bare, self.k), start.ravel()
            seen = np.isfinite(upper[i, j])
            self._rerank(i[seen], j[seen], ids, vectors, unit)
            upper[i, j] = -np.inf
        upper += self.levels.bound(scalars, self.epsilon)
        upper += np.float32(1e-5)
        i, j = np.nonzero((upper >= self.least().astype(np.float32)[:, None]) & np.isfinite(upper))
        for start in range(0, len(i), RERANKED_AT_ONCE):
            part = slice(start, start + RERANKED_AT_ONCE)
            self._rerank(i[part], j[part], ids, vectors, unit)

    def _rerank(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray, unit: np.ndarray) -> None:
        # in floats first; what may reach the least score by their error is scored in doubles
        near = np.einsum("ij,ij->i", self.unit[i], unit[j]) + (1e-6 + 1.5e-7 * unit.shape[1])
        hopeful = near >= self.least()[i]
        i, j = i[hopeful], j[hopeful]
        scores = cosine(self.vectors[i], vectors[j])
        good = scores >= self.least()[i]
        i, found, scores = i[good], ids[j[good]], scores[good]
        touched = np.unique(i)
        held = np.isfinite(self.scores[touched])
        i = np.concatenate([np.repeat(touched, held.sum(axis=1)), i])
        found = np.concatenate([self.best[touched][held], found])
        scores = np.concatenate([self.scores[touched][held], scores])
        order = np.lexsort((found, -scores, i))
        i, found, scores = i[order], found[order], scores[order]
        starts = np.searchsorted(i, i)
        place = np.arange(len(i)) - starts
        keep = place < self.k
        self.scores[touched], self.best[touched] = -np.inf, np.iinfo(np.int64).max
        self.scores[i[keep], place[keep]], self.best[i[keep], place[keep]] = scores[keep], found[keep]

    def result(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[q]), pa.array(self.ids[q]), pa.array(self.best[q, place]), pa.array(self.scores[q, place])],
            schema=FOUND_ARROW,
        )


UNIT = ("dimension", "group", "shard")


def _search(k: int, epsilon: float):
    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of one unit and kind."""
        columns = [batch.column(c).to_numpy() for c in (*UNIT, "kind")]
        changes = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        edges = np.flatnonzero(changes) + 1
        for start, end in zip([0, *edges], [*edges, len(batch)]):
            yield batch.slice(start, end - start)

    def begin(queries: list[pa.RecordBatch]) -> Search:
        held = pa.Table.from_batches(queries).combine_chunks()
        floors = held.column("floor").fill_null(-np.inf).to_numpy()
        vectors = _matrix(held.column("vector"), held.column("dimension")[0].as_py())
        return Search(held.column("row").to_numpy(), held.column("vec_id").to_numpy(), floors, vectors, k, epsilon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries, search = None, [], None
        for batch in batches:
            for part in parts(batch) if len(batch) else ():
                own = tuple(part.column(c)[0].as_py() for c in UNIT)
                if own != unit:
                    if search:
                        yield search.result()
                    unit, queries, search = own, [], None
                if part.column("kind")[0].as_py() == 0:
                    queries.append(part)
                    continue
                if search is None and queries:
                    search = begin(queries)
                chunk = max(16, PAIRS_AT_ONCE // len(search.rows)) if search else 1
                for start in range(0, len(part) if search else 0, chunk):
                    some = part.slice(start, chunk)
                    codes = np.frombuffer(b"".join(some.column("code").to_pylist()), dtype=np.uint8).reshape(len(some), -1)
                    search.see(
                        some.column("row").to_numpy(), some.column("vec_id").to_numpy(), _matrix(some.column("vector"), own[0]),
                        words(codes), some.column("scalar").to_numpy(),
                    )
        if search:
            yield search.result()

    return run


def index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """All usable rows with their codes, staged. Vectors of floats stay floats, which are exact as doubles."""
    given = F.col(f"`{vector_column}`")
    kind = np.float32 if dict(vectors.dtypes)[vector_column] == "array<float>" else np.float64
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("vec_id"),
            given.cast("array<double>").alias("vector"),
        )
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
        .select("row", "vec_id", "vector")
    )
    return stage(rows.mapInArrow(_code(kind), CODED), "one-bit-codes")


def _every(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n) - 1))


def _met(queries: DataFrame, candidates: DataFrame, k: int, epsilon: float) -> DataFrame:
    """The k best of each query in each of its units. Both sides have ``group`` and ``shard``; queries also ``floor``."""
    columns = [*UNIT, "kind", "row", "vec_id", "vector", "code", "scalar", "floor"]
    nothing = {"code": F.lit(None).cast("binary"), "scalar": F.lit(None).cast("double")}
    asked = queries.withColumns({"kind": F.lit(0), **nothing}).select(columns)
    seen = candidates.withColumns({"kind": F.lit(1), "floor": F.lit(None).cast("double")}).select(columns)
    units = asked.unionByName(seen).repartition(*UNIT).sortWithinPartitions(*UNIT, "kind")
    return units.mapInArrow(_search(k, epsilon), FOUND)


def search(coded: DataFrame, is_query: Column, k: int, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which ``is_query`` holds (over vec_id)."""
    counts = coded.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("queries"))
    held = F.greatest(F.lit(FEWEST_QUERIES), F.least(F.lit(MOST_QUERIES), F.floor(F.lit(QUERY_ELEMENTS) / F.col("dimension"))))
    groups = F.greatest(F.lit(1), F.ceil(F.col("queries") / held))
    sizes = stage(
        counts.withColumn("groups", groups.cast("int")).select(
            "dimension",
            "n",
            "groups",
            F.greatest(F.ceil(F.col("n") / SHARD_ROWS), F.ceil(F.lit(LEAST_UNITS) / F.col("groups"))).cast("int").alias("shards"),
            F.greatest(F.lit(1), F.ceil(F.col("queries") / SEED_QUERIES)).cast("int").alias("seed_groups"),
        ),
        "one-bit-sizes",
    )
    # One row a vector length. m lengths need m^2 / 2 components, so 10^13 components have less than 5 * 10^6 lengths.
    sized = coded.join(F.broadcast(sizes), "dimension")

    def dealt(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), n)

    asked = sized.filter(is_query)
    unknown = F.lit(None).cast("double").alias("floor")
    sample = sized.filter(dealt(F.col("n"), 1) < SEED_ROWS)
    seeds = _met(
        asked.select("*", dealt(F.col("seed_groups"), 2).alias("group"), F.lit(0).alias("shard"), unknown),
        sample.select("*", _every(F.col("seed_groups")).alias("group"), F.lit(0).alias("shard")),
        k,
        epsilon,
    )
    floors = seeds.groupBy(F.col("query_row").alias("row")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("found"))
    floored = asked.join(floors.filter(F.col("found") == k).select("row", "floor"), "row", "left")
    found = _met(
        floored.select("*", dealt(F.col("groups"), 3).alias("group"), _every(F.col("shards")).alias("shard")),
        sized.select("*", _every(F.col("groups")).alias("group"), dealt(F.col("shards"), 4).alias("shard")),
        k,
        epsilon,
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
