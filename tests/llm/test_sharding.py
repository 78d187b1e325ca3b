from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from rankjobs.llm import sharding
from tests.llm.conftest import HOSTILE, sentence


def check(result, shards):
    slots = defaultdict(list)
    for r in result:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_balanced(docs_of):
    rows = [(i, sentence(i % 50 + 1, i % 700) if i % 3 else sentence(30, 0), "abc"[i % 3]) for i in range(4000)]
    for shards in (1, 7, 24):
        result = sharding.kd_shards(docs_of(rows).repartition(5), shards).collect()
        check(result, shards)
        assert Counter(r["doc_id"] for r in result) == Counter(i for i, _, _ in rows)
        size = Counter()
        for r in result:
            size[r["shard"]] += r["size"]
        assert len(size) == shards and max(size.values()) - min(size.values()) <= 6 * max(r["size"] for r in result)


def test_equal_texts_of_one_source_stay_together_where_balance_allows(docs_of):
    rows = [(i, f"text {i // 2}", "a") for i in range(400)]
    by_text = defaultdict(set)
    for r in sharding.kd_shards(docs_of(rows), 4).collect():
        by_text[r["doc_id"] // 2].add(r["shard"])
    assert sum(len(s) > 1 for s in by_text.values()) <= 3


def test_sources_with_one_prefix_are_told_apart(docs_of):
    rows = [(i, "x" * 20 + f"{i:04}", f"common_crawl_{'abcd'[i % 4]}") for i in range(400)]
    by_shard = defaultdict(set)
    for r in sharding.kd_shards(docs_of(rows), 4).collect():
        by_shard[r["shard"]].add("abcd"[r["doc_id"] % 4])
    assert sorted(map(sorted, by_shard.values())) == [["a"], ["b"], ["c"], ["d"]]


def test_target_bytes(docs_of):
    rows = [(i, sentence(20, i), "a") for i in range(500)]
    result = sharding.kd_shards(docs_of(rows), target_bytes=10_000).collect()
    total = sum(r["size"] for r in result)
    assert len({r["shard"] for r in result}) == -(-total // 10_000)


def test_hostile_rows(hostile, nothing):
    result = sharding.kd_shards(hostile, 24).collect()
    check(result, 24)
    assert sorted((r["size"], r["text_crc32"]) for r in result) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in HOSTILE
    )
    assert sharding.kd_shards(nothing, 24).count() == 0


def test_many_rows_equal_in_id_and_text_are_balanced(docs_of):
    rows = [(None, "one text", "a")] * 1000 + [(i, sentence(3, i), "b") for i in range(500)]
    result = sharding.kd_shards(docs_of(rows).repartition(4), 4).collect()
    check(result, 4)
    size = Counter()
    for r in result:
        size[r["shard"]] += r["size"]
    assert len(size) == 4 and max(size.values()) <= 1.05 * sum(size.values()) / 4
