"""Whiten embeddings with a bidiagonal qd solver.

1. One pass sums the integer entries x = floor(64 c) + 1000000 per dimension.
2. Tasks centre their rows and reduce them block by block with QR; the triangles of the
   tasks are merged in a tree, ``FAN`` at a time, until one is left. Rows never gather.
3. The last triangle, as wide as the vectors, is bidiagonalised by Householder reflections.
   dqds finds the squares of its singular values with high relative accuracy; a twisted
   factorisation at each of the largest gives its vector, which the reflections turn into a
   unit eigenvector of the covariance. Vectors of close values are made orthogonal.
4. Rows are projected where they are read. The covariance of the projected rows is summed
   as centred blocks that are merged in the same tree, and compared with the identity.

Memory: a block has ``BLOCK_ROWS`` rows; a triangle has the square of the dimension, whatever
the number of rows is. Only triangles and sums come to the driver.

Defined results: vectors that are null or hold null or not finite entries take no part;
rows with a null id are rows like any other, so are repeated rows. Vectors of each length
are a fit list of their own. Components whose eigenvalue is 0 to rounding have a null
``whitened`` and explain 0 (null if no vector differs from the mean). Empty vectors have
no components. An entry or deviation beyond 64 bits fails the job. An empty table gives an
empty result. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.sources.artifacts import stage

COMPONENTS = 32
BLOCK_ROWS = 4096
FAN = 16
EPS = np.finfo(float).eps

SUMS = pa.schema([("length", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])
BLOCKS = "length int, block bigint, n bigint, state binary"
BLOCKS_ARROW = pa.schema([("length", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])
PROJECTED = "vec_id bigint, length int, deviation bigint, whitened array<double>"


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and the product of the right reflections: r = Q B right^T."""
    a, n = r.copy(), len(r)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for j in range(n):
        v = reflector(a[j:, j])
        if v is not None:
            a[j:, j:] -= 2 * np.outer(v, v @ a[j:, j:])
        if j < n - 2:
            v = reflector(a[j, j + 1 :])
            if v is not None:
                a[j:, j + 1 :] -= 2 * np.outer(a[j:, j + 1 :] @ v, v)
                right[:, j + 1 :] -= 2 * np.outer(right[:, j + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step with a shift; None where the shift is above the smallest value."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        both = d + e[k]
        ratio = q[k + 1] / both if both > 0 else 0.0
        new_q.append(both)
        new_e.append(e[k] * ratio)
        d = (d * ratio if both > 0 else q[k + 1]) - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by shifted qd steps."""
    out: list[float] = []
    parts = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while parts:
        q, e, moved = parts.pop()
        steps = 0
        while q:
            if len(q) == 1 or e[-1] <= EPS * EPS * (moved + q[-1]):
                out.append(moved + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * moved or e[k] < 1e-300), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # the smaller value of the last two rows is what the smallest one is near to
            a, b, c = q[-2] + e[-1], math.sqrt(q[-1] * e[-1]), q[-1]
            gap = math.hypot(a - c, 2 * b)
            shift = max(0.0, (a * c - b * b) / (0.5 * (a + c + gap))) if a + c + gap > 0 else 0.0
            made = None
            for _ in range(6):
                if shift <= EPS * moved:
                    break
                made = _transform(q, e, shift)
                if made is not None:
                    break
                shift *= 0.5
            if made is None:
                shift, made = 0.0, _transform(q, e, 0.0)
            (q, e), moved, steps = made, moved + shift, steps + 1
            if steps > 200 * (len(diagonal) + 1):
                raise ArithmeticError("the qd iteration did not settle")
    return np.sort(np.array(out))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float):
    """Factors of L D L^T - value from the top and from the bottom, and the best place to join them."""
    n, tiny = len(d), EPS * EPS * max(abs(value), d.max())
    s, p = np.empty(n), np.empty(n)
    top, bottom = np.empty(n - 1), np.empty(n - 1)
    pivots = np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivots[i] = s[i] + d[i] or tiny
        top[i] = d[i] * low[i] / pivots[i]
        s[i + 1] = top[i] * low[i] * s[i] - value
    pivots[-1] = s[-1] + d[-1] or tiny
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = d[i] / (d[i] * low[i] ** 2 + p[i + 1] or tiny)
        bottom[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    return top, pivots, bottom, int(np.argmin(np.abs(s + p + value)))


def vectors_of(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (columns) for some of the squared singular values, in falling order."""
    n = len(diagonal)
    # a zero on the diagonal is moved by a rounding error of the largest entry
    least = EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    d, low = diagonal**2, above / diagonal[:-1]
    out = np.empty((n, len(squares)))
    random = np.random.default_rng(5)
    start = 0
    for j, value in enumerate(squares):
        if j and squares[j - 1] - value > 1e-3 * squares[j - 1]:
            start = j
        top, pivots, bottom, k = _twisted(d, low, float(value))
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -top[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -bottom[i] * z[i]
        z /= np.linalg.norm(z)
        near = out[:, start:j]
        for _ in range(3 if j > start else 0):
            # close values: inverse iteration, orthogonal to the vectors before
            z -= near @ (near.T @ z)
            size = np.linalg.norm(z)
            z = z / size if size > 1e-2 else random.standard_normal(n)
            z -= near @ (near.T @ z)
            for i in range(1, n):
                z[i] -= top[i - 1] * z[i - 1]
            z /= np.where(np.abs(pivots) < EPS * d.max(), EPS * d.max(), pivots)
            for i in range(n - 2, -1, -1):
                z[i] -= top[i] * z[i + 1]
            z /= np.linalg.norm(z)
            z -= near @ (near.T @ z)
            z -= near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def components_of(triangle: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and eigenvectors (columns) of triangle^T triangle / n, and the trace; values of 0 are left out."""
    size = np.abs(triangle).max(initial=0.0)
    if size == 0:
        return np.empty(0), np.empty((len(triangle), 0)), 0.0
    diagonal, above, right = bidiagonalise(triangle / size)
    squares = singular_squares(diagonal, above)
    used = squares[: min(most, len(squares))]
    used = used[used > (len(triangle) * EPS) ** 2 * squares[0]]
    scale = size * size / n
    return used * scale, right @ vectors_of(diagonal, above, used), float(np.square(triangle).sum()) / n


def _integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, x) for the vectors of each length."""
    vectors = batch.column("vector")
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    scaled = np.floor(64 * flat)
    if (np.abs(scaled) >= 2.0**62).any():
        raise OverflowError("a vector has an entry that does not fit 64 bits")
    x = scaled.astype(np.int64) + 1_000_000
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, x[(ends[own] - size)[:, None] + np.arange(size)]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for own, x in _integers(batch):
            n, total = sums.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=np.int64)))
            sums[x.shape[1]] = (n + len(own), total + x.sum(axis=0))
    for length, (n, total) in sums.items():
        if length:
            columns = [np.full(length, length, np.int32), np.arange(length, dtype=np.int32), np.full(length, n), total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=SUMS)


def _block(length: int, n: int, state: np.ndarray) -> pa.RecordBatch:
    block = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([length], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([state.tobytes()], pa.binary())],
        schema=BLOCKS_ARROW,
    )


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(r)] = r
    return out


def _triangles(sums: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _integers(batch):
                if not x.shape[1]:
                    continue
                n, total = sums[x.shape[1]]
                centred = (n * x - total) / n
                for start in range(0, len(x), BLOCK_ROWS):
                    block = [held.get(x.shape[1]), centred[start : start + BLOCK_ROWS]]
                    held[x.shape[1]] = _triangle(np.vstack([b for b in block if b is not None]))
        for length, r in held.items():
            yield _block(length, 0, r)

    return run


def _merge_triangles(states: list[tuple[int, np.ndarray]], width: int) -> tuple[int, np.ndarray]:
    return 0, _triangle(np.vstack([r.reshape(width, width) for _, r in states]))


def _merge_moments(states: list[tuple[int, np.ndarray]], width: int) -> tuple[int, np.ndarray]:
    """Counts, means and centred products of blocks, merged without subtracting large numbers."""
    n, state = states[0]
    mean, products = state[:width].copy(), state[width:].reshape(width, width).copy()
    for more, other in states[1:]:
        apart = other[:width] - mean
        products += other[width:].reshape(width, width) + np.outer(apart, apart) * (n * more / (n + more))
        mean += apart * (more / (n + more))
        n += more
    return n, np.concatenate([mean, products.ravel()])


def _tree(blocks: DataFrame, merge: Callable, widths: dict[int, int], name: str) -> dict[int, tuple[int, np.ndarray]]:
    """Merge the blocks of each length, ``FAN`` neighbours at a time, down to one."""
    blocks = stage(blocks, name)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        length = int(group["length"].iloc[0])
        states = [(int(n), np.frombuffer(s)) for n, s in zip(group["n"], group["state"])]
        n, state = merge(states, widths[length])
        return pd.DataFrame({"length": [length], "block": [group["block"].iloc[0] // FAN], "n": [n], "state": [state.tobytes()]})

    last = blocks.agg(F.max("block")).first()[0] or 0
    while True:
        blocks = stage(blocks.groupBy("length", F.floor(F.col("block") / FAN)).applyInPandas(run, BLOCKS), name)
        last //= FAN
        if not last:
            return {r["length"]: (r["n"], np.frombuffer(bytes(r["state"]))) for r in blocks.collect()}


def _project(sums: dict, models: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _integers(batch):
                length = x.shape[1]
                if not length:
                    continue
                n, total = sums[length]
                values, vectors, _ = models[length]
                apart = n * x - total
                if (np.square(apart.astype(np.float64)).sum(axis=1) >= 2.0**63).any():
                    raise OverflowError("a deviation does not fit 64 bits")
                whitened = (apart / n) @ vectors / np.sqrt(values)
                width = whitened.shape[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(whitened.ravel(), pa.float64())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(own)), pa.array(np.full(len(own), length, np.int32)),
                        pa.array(np.square(apart).sum(axis=1)), lists,
                    ],
                    names=["vec_id", "length", "deviation", "whitened"],
                )

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        for length in np.unique(lengths):
            part = batch.column("whitened").take(pa.array(np.flatnonzero(lengths == length)))
            width = len(part[0])
            if not width:
                continue
            rows = part.flatten().to_numpy().reshape(-1, width)
            mean = rows.mean(axis=0)
            centred = rows - mean
            state = (len(rows), np.concatenate([mean, (centred.T @ centred).ravel()]))
            held[int(length)] = _merge_moments([held[int(length)], state], width) if int(length) in held else state
    for length, (n, state) in held.items():
        yield _block(length, n, state)


def whiten(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
        .filter(F.col("vector").isNotNull())
        .filter(~bad)
    )
    totals = rows.mapInArrow(_sum_up, "length int, place int, n bigint, total bigint").groupBy("length", "place")
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for r in totals.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        sums.setdefault(r["length"], (r["n"], np.zeros(r["length"], dtype=np.int64)))[1][r["place"]] = r["total"]
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not sums:
        return spark.createDataFrame([], schema)
    triangles = _tree(rows.mapInArrow(_triangles(sums), BLOCKS), _merge_triangles, {d: d for d in sums}, "triangles")
    models = {d: components_of(r.reshape(d, d), sums[d][0], components) for d, (_, r) in triangles.items()}
    projected = stage(rows.mapInArrow(_project(sums, models), PROJECTED), "whitened")
    widths = {d: len(values) for d, (values, _, _) in models.items()}
    moments = _tree(projected.mapInArrow(_moments, BLOCKS), _merge_moments, widths, "moments") if any(widths.values()) else {}

    out = None
    for d, (values, _, trace) in sorted(models.items()):
        most = min(d, components)
        shares = [float(v) / trace for v in values] + [0.0 if trace else None] * (most - len(values))
        error = None
        if d in moments:
            n, state = moments[d]
            error = float(np.abs(state[len(values) :].reshape(len(values), -1) / n - np.eye(len(values))).max())
        places = F.posexplode(F.sequence(F.lit(1), F.lit(most))).alias("_place", "component")
        part = projected.filter(F.col("length") == d).select("vec_id", "deviation", "whitened", places)
        part = part.select(
            "vec_id", "component", F.lit(sums[d][0]).cast("bigint").alias("n"), "deviation",
            F.get("whitened", F.col("_place")).alias("whitened"),
            F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("_place")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
        out = part if out is None else out.unionByName(part)
    return out
