from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from rankjobs.llm import exact_dedup as op
from tests.llm.conftest import HOSTILE


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


def test_golomb_codes_are_read_back():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 100, 5000):
        for high in (n, 10 * n, 1 << 40, (1 << 64) - 1):
            values = np.unique(r.integers(0, high, n, dtype=np.uint64, endpoint=True))
            width, coded = op.golomb_encode(values)
            assert (op.golomb_decode(len(values), width, coded) == values).all()
    values = np.unique(r.integers(0, 1 << 63, 10_000, dtype=np.uint64))
    width, coded = op.golomb_encode(values)
    assert len(coded) * 8 / len(values) < width + 2.6 < 56


def test_hostile_rows(hostile, nothing):
    assert rows_of(op.exact_duplicates(hostile)) == expected([(r[0], r[1]) for r in HOSTILE])
    assert op.exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1 << 20])
def test_hot_group_over_cut_chunks(spark, docs_of, broadcast_rows):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i // 4}", "a") for i in range(3000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = rows_of(op.exact_duplicates(docs_of(rows).repartition(7), broadcast_rows=broadcast_rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected([(i, t) for i, t, _ in rows])


def test_distinct_documents_keep_their_columns(hostile, nothing):
    kept = op.distinct_documents(hostile)
    assert kept.columns == hostile.columns
    want = sorted((e[0], e[4]) for e in expected([(r[0], r[1]) for r in HOSTILE]) if e[3] and e[0] is not None)
    got = sorted((r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()) for r in kept.collect() if r["doc_id"] is not None)
    assert got == want
    assert kept.filter("doc_id IS NULL").count() == 1
    assert op.distinct_documents(nothing).count() == 0


def test_rows_are_dropped_alike_by_both_ways(spark, hostile):
    from pyspark.sql import functions as F

    from rankjobs.llm.decisions import kept_rows

    key = F.md5(F.coalesce("text", F.lit("")))
    decisions = hostile.select("doc_id", key.alias("key"), (F.coalesce("doc_id", F.lit(0)) % 3 != 0).alias("kept"))
    # one of the rows that are equal in id and key stays, though one of them is dropped
    decisions = decisions.unionByName(decisions.filter("doc_id = 5").limit(1).withColumn("kept", F.lit(False)))
    ways = [kept_rows(hostile, decisions, key, broadcast_rows=n) for n in (1 << 20, 0)]
    want = sorted(str(r[0]) for r in HOSTILE if r[0] is not None and r[0] % 3 and r[0] != 5) + ["5"]
    for way in ways:
        assert way.columns == hostile.columns
        assert sorted(str(r["doc_id"]) for r in way.collect()) == sorted(want)
