"""Token vectors hold a few texts at a time."""

from __future__ import annotations

import pyarrow as pa

from rankjobs.operators import embed


def test_token_vectors_are_made_a_few_texts_at_a_time(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"w{i % 3} x y") for i in range(50)], "id bigint, text string").coalesce(1)
    want = sorted(map(tuple, embed.token_hash_vectors(frame, "id", "text", dim=16).collect()))
    monkeypatch.setattr(embed, "TEXTS_AT_ONCE", 7)
    sizes = embed.token_hash_vectors(frame, "id", "text", dim=16).select("id").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches), "n bigint"
    )
    assert sizes.agg({"n": "sum"}).first()[0] == 50
    assert sorted(map(tuple, embed.token_hash_vectors(frame, "id", "text", dim=16).collect())) == want
