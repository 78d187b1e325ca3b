from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from rankjobs.llm import graph, jaccard
from tests.llm.conftest import HOSTILE, sentence


def brute(rows):
    """(links, smallest id of the group) for each row."""

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    smallest = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return [(rows[k][0], links[k], smallest[find(k)], len(groups[find(k)])) for k in range(len(rows))]


def result_of(df):
    return sorted(((r["doc_id"], r["n_links"], r["class_id"], r["class_size"]) for r in df.collect()), key=repr)


def near_copies(n, seed, changes=2):
    r = random.Random(seed)
    words = sentence(120, seed).split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(docs_of):
    texts = [sentence(40, 1000 + k) for k in range(60)]
    for seed in range(12):
        texts += near_copies(8, seed, changes=seed)
    shared = sentence(60, 77)
    texts += [f"{shared} {sentence(20 + k, 500 + k)}" for k in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[60]) for i in range(25)]
    got = result_of(jaccard.near_duplicates(docs_of([(i, t, "a") for i, t in rows]).repartition(6)))
    assert got == sorted(brute(rows), key=repr)


def test_a_large_group_in_small_blocks(docs_of):
    rows = list(enumerate(near_copies(150, 5, changes=3) + [sentence(30, 900 + k) for k in range(50)]))
    got = result_of(jaccard.near_duplicates(docs_of([(i, t, "a") for i, t in rows]), block=16, text_block=8, broadcast_rows=0))
    assert got == sorted(brute(rows), key=repr)


def test_hostile_rows(hostile, nothing):
    result = jaccard.near_duplicates(hostile)
    assert result_of(result) == sorted(brute([(r[0], r[1]) for r in HOSTILE]), key=repr)
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.one_of_each_group(hostile)
    assert kept.columns == hostile.columns
    assert kept.count() == result.filter("kept").count()
    assert jaccard.one_of_each_group(nothing).count() == 0


def test_posterior_and_pruning():
    assert abs(jaccard.beta_tail(0.5, 3, 3) - 0.5) < 1e-12
    steps = jaccard.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 97, 16))
    assert all(m < 0.8 * n for n, m in steps) and steps[-1][1] > 50
    r = np.random.default_rng(0)
    left = r.integers(0, 1 << 16, (1, jaccard.HASHES), dtype=np.uint16)
    right = np.repeat(left, 2, axis=0)
    right[1, r.random(jaccard.HASHES) > 0.3] ^= 1
    i, j = jaccard.prune(left, right, np.array([0, 0]), np.array([0, 1]), steps)
    assert j.tolist() == [0]


def test_intersections_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 100).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert jaccard.shared_counts(sets, sets, i, j).tolist() == want
    assert jaccard.shared_counts(sets, sets, i[:3], j[:3]).tolist() == want[:3]


def test_units_are_never_cut():
    ids = np.sort(np.random.default_rng(2).integers(0, 40, 500))
    table = pa.table({"unit": ids})
    for rows in (1, 7, 100):
        seen = []
        for part in jaccard.units(iter(table.to_batches(max_chunksize=13)), rows):
            units = part.column("unit").to_pylist()
            assert not set(units) & {u for s in seen for u in s}
            seen.append(units)
        assert [u for s in seen for u in s] == ids.tolist()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
