from __future__ import annotations

import numpy as np
import pytest

from rankjobs.llm import whitening

FIELDS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")


def integers(vectors):
    return np.floor(64 * np.asarray(vectors, dtype=float)).astype(np.int64) + 1_000_000


def check(df, vectors, components=32):
    """Against numpy's eigenvectors of the covariance of all rows."""
    assert df.columns == FIELDS
    rows = df.collect()
    x = integers(vectors)
    n, d = x.shape
    total = x.sum(axis=0)
    centred = (n * x - total) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    most = min(d, components)
    assert len(rows) == n * most
    got = np.full((n, most), np.nan)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = np.nan if r["whitened"] is None else r["whitened"]
        assert r["n"] == n
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], total))
        if r["component"] <= most:
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9, abs=1e-12)
        assert r["identity_error"] < 1e-9
    used = [j for j in range(most) if values[j] > 1e-9 * values[0]]
    assert np.isfinite(got[:, used]).all() and np.isnan(np.delete(got, used, axis=1)).all()
    want = centred @ vecs[:, used] / np.sqrt(values[used])
    # the sign is free, and so is the basis where values are equal
    for j in used:
        apart = np.abs(values[used] - values[j]) > 1e-6 * values[j]
        if apart.sum() == len(used) - 1:
            sign = np.sign(got[:, j] @ want[:, used.index(j)])
            assert np.abs(sign * got[:, j] - want[:, used.index(j)]).max() < 1e-7
    cov = got[:, used].T @ got[:, used] / n
    assert np.abs(cov - np.eye(len(used))).max() < 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_against_eigenvectors(spark, parts):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((500, 40)) @ r.standard_normal((40, 40)) + 100).tolist()
    check(whitening.whiten(frame(spark, vectors).repartition(parts)), vectors)


def test_fewer_rows_than_dimensions_and_repeated_rows(spark):
    r = np.random.default_rng(2)
    vectors = np.repeat(r.standard_normal((6, 12)) * 50, 3, axis=0).tolist()
    check(whitening.whiten(frame(spark, vectors)), vectors)


def test_equal_eigenvalues(spark):
    vectors = [[4.0 if j == i % 8 else 0.0 for j in range(8)] for i in range(80)]
    check(whitening.whiten(frame(spark, vectors), components=5), vectors, 5)


def test_a_third_is_one_vector(spark):
    r = np.random.default_rng(4)
    vectors = r.standard_normal((300, 16)).tolist()
    vectors[::3] = [vectors[0]] * len(vectors[::3])
    check(whitening.whiten(frame(spark, vectors).repartition(9)), vectors)


def test_unusable_vectors_and_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (None, [5.0, 2.5]), (7, [0.0, 0.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, length string, whitened double")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, c) for i in (1, 0, 7, 7) for c in (1, 2))
    assert {r["n"] for r in got} == {4}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.limit(0)).columns == FIELDS


def test_no_spread_and_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, [2.0]), (5, [])], "vec_id bigint, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert got[1, 1]["whitened"] is None and got[1, 1]["explained"] is None and got[1, 1]["deviation"] == 0
    assert abs(got[3, 1]["whitened"]) == pytest.approx(1) and got[3, 1]["explained"] == 1.0 and got[3, 1]["n"] == 2


def test_too_large_entries_fail(spark):
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(frame(spark, [[1e300], [1.0]])).collect()


def test_registered_query(spark):
    from rankjobs.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = QUERIES["op11_whitening"][0](spark, sf_dir)
    assert dict(rows.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    places = {r["vec_id"]: i for i, r in enumerate(table)}
    assert len(places) == len(table)
    from pyspark.sql import functions as F

    of = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    check(rows.withColumn("vec_id", of[F.col("vec_id")].cast("bigint")).select(*FIELDS), [r["embedding"] for r in table])


@pytest.mark.parametrize("kind", ["random", "clustered", "graded", "equal", "zeros"])
def test_solver_alone(kind):
    r = np.random.default_rng(3)
    a = r.standard_normal((300, 60))
    if kind == "clustered":
        a = np.repeat(r.standard_normal((10, 60)) * 100, 30, axis=0) + a
    if kind == "graded":
        a *= 10.0 ** -np.linspace(0, 7, 60)
    if kind == "equal":
        a = np.eye(60)[np.arange(300) % 60]
    if kind == "zeros":
        a[:, 5:50] = 0
    values, vectors, trace = whitening.components_of(whitening._triangle(a), len(a), 32)
    want = np.linalg.svd(a, compute_uv=False) ** 2 / len(a)
    assert np.abs(values / want[: len(values)] - 1).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert trace == pytest.approx(want.sum())
    white = a @ vectors / np.sqrt(values)
    assert np.abs(white.T @ white / len(a) - np.eye(len(values))).max() < 1e-9
    assert len(values) == (15 if kind == "zeros" else 32)
