from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankjobs.llm import divergence
from tests.llm.conftest import HOSTILE, SCHEMA


def brute_force(rows, min_documents=10, top=10):
    """The definition, with Python's integers and regular expressions."""
    import re

    docs = [(t or "", lang or "", s or "") for _, t, lang, s, _ in rows]
    words = [
        [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)] for t, _, _ in docs
    ]
    out = []
    for lang in sorted({lang for _, lang, _ in docs}):
        holds = Counter(w for ws, d in zip(words, docs) if d[1] == lang for w in set(ws))
        kept = sorted(w for w, n in holds.items() if n >= min_documents)
        counts = defaultdict(Counter)
        for ws, (_, own, source) in zip(words, docs):
            if own == lang:
                counts[source].update(w for w in ws if w in set(kept))

        def shares(count):
            n = sum(count.values())
            return {w: 1 + 10**9 * (count[w] + 2) // (n + 2 * len(kept)) for w in kept}

        def gap(p, q):
            return (p - q) * (p - q) // (p + q)

        q = shares(sum(counts.values(), Counter()))
        p = {source: shares(count) for source, count in counts.items()}
        for source in counts:
            pairs = [(sum(gap(p[source][w], p[o][w]) for w in kept), o) for o in counts if o != source]
            terms = [(gap(p[source][w], q[w]), w) for w in kept if counts[source][w] and p[source][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def drawn(n, seed=1):
    r = random.Random(seed)
    names = [f"{a}{b}" for a in "abcdeéſ中" for b in "xyzÄ"] + ["The", "THE", "the"]
    rows = []
    for i in range(n):
        source = r.choice(["s1", "s2", "s3", "é", None])
        common = r.choices(names, weights=[1 + (k % (3 + len(source or ""))) for k in range(len(names))], k=r.randint(0, 30))
        rows.append((i, r.choice([" ", "-", "\n", "_7"]).join(common), r.choice(["en", "en", "de", None]), source, None))
    # a language whose terms are all rare, and one without terms
    rows += [(n, "rare words", "xx", "s1", 1), (n + 1, "more", "xx", "s2", 1), (n + 2, "12 34", "yy", "s1", 1), (n + 3, None, "yy", "s2", 1)]
    return rows


def results(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"shard_terms": 1, "broadcast_bytes": 1}])
def test_against_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", 1)
    rows = drawn(400)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert results(divergence.divergences(frame, **settings)) == brute_force(rows)


def test_hot_source_and_copies(spark):
    rows = drawn(120) + [(500 + i, "same words here " * 3, "en", "hot", None) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert results(divergence.divergences(frame)) == brute_force(rows)


def test_small_buffers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "DENSE_BYTES", 8)
    rows = drawn(150, seed=3)
    got = [b for b in divergence._frequencies(iter([_batch(rows[:70]), _batch(rows[70:])]))]
    assert len(got) > 10
    shared = type("Shared", (), {"value": {}})
    whole = Counter()
    for batch in got:
        for lang, term, n in zip(*(c.to_pylist() for c in batch.columns)):
            whole[lang, term] += n
    plain = Counter((lang or "", w) for _, t, lang, _, _ in rows for w in set(divergence.terms_of((t or "").encode())))
    assert whole == plain
    assert list(divergence._recount(shared, 1)(iter([_batch(rows)]))) == []


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(
        {"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [(r[1] or "").encode() for r in rows]}
    )


def test_perfect_hash_is_minimal_and_knows_strangers():
    terms = [f"t{i}".encode() for i in range(20_000)]
    made = divergence.PerfectHash.build(terms, divergence.digests_of(terms))
    assert sorted(made.slots_of(terms, divergence.digests_of(terms))) == list(range(len(terms)))
    strange = [f"u{i}".encode() for i in range(5_000)]
    assert (made.slots_of(strange, divergence.digests_of(strange)) == -1).all()
    assert not made.listed and len(made.words) < 20


def test_equal_digests_are_listed():
    terms, digests = [b"a", b"b", b"c", b"d"], np.array([5, 5, 5, 9], dtype=np.uint64)
    made = divergence.PerfectHash.build(terms, digests)
    assert len(made.listed) == 3
    assert sorted(made.slots_of(terms, digests)) == [0, 1, 2, 3]
    assert made.slots_of([b"x"], np.array([5], dtype=np.uint64)).tolist() == [-1]
    assert [made.keys[int(s)].as_py() for s in made.slots_of(terms, digests)] == terms


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 3, 10**13, 4 * 10**14], dtype=np.int64)
    total, terms = int(counts.sum()), 5
    want = [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
    assert divergence.shares(counts, total, terms).tolist() == want


def test_rounds_hold_at_most_the_bound():
    sizes = [("a", i, 10) for i in range(5)] + [("b", 0, 100), ("c", 0, 1)]
    assert divergence.rounds_of(sizes, 25) == [
        [("a", 0), ("a", 1)], [("a", 2), ("a", 3)], [("a", 4)], [("b", 0)], [("c", 0)]
    ]


def test_hostile_rows(hostile, nothing):
    assert results(divergence.divergences(hostile, min_documents=1)) == brute_force(HOSTILE, 1)
    assert divergence.divergences(nothing).count() == 0
