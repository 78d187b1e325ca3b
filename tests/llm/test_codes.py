"""Nearest neighbours, SentencePiece, and the pipeline."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rankjobs.llm import ann, jaccard
from rankjobs.llm import sentencepiece_fst as fst
from tests.llm.conftest import HOSTILE, sentence

SF_DIR = "/root/testdata/sf0.001"


def nearest(vectors, queries, k):
    ids = sorted(vectors)
    out = []
    for q in queries:
        a = np.array(vectors[q])
        scored = []
        for i in ids:
            if i != q:
                b = np.array(vectors[i])
                scored.append((-float(ann.cosine(a[None], b[None])[0]), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_search_against_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((5, 48))
    vectors = {i: (centres[i % 5] + 0.7 * r.standard_normal(48)).tolist() for i in range(1200)}
    for i in range(400, 700):  # a hot vector
        vectors[i] = vectors[400]
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").repartition(5)
    from pyspark.sql import functions as F

    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in ann.search(ann.index(df), F.pmod("vec_id", F.lit(50)) == 0, 5).collect()}
    want = nearest(vectors, range(0, 1200, 50), 5)
    assert len(got) == len(want)
    hits = sum(got[q, rank] == (i, s) for q, rank, i, s in want)
    assert hits / len(want) >= 0.95
    assert all(got[q, rank] == (i, s) for q, rank, i, s in want if 400 <= q < 700)


def test_error_bounds_hold():
    r = np.random.default_rng(4)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    data, queries = r.standard_normal((2000, 64)), r.standard_normal((20, 64))
    _, codes, scalars = ann.encode(data, turn)
    rotated = ann.encode(queries, turn)[0]
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    levels = ann.Levels(rotated)
    estimate = levels.estimate(ann.words(codes), scalars)
    unrounded = rotated @ signs.T / 8 / scalars
    assert np.abs(estimate - unrounded).std() < 0.02
    assert (np.abs(estimate - unrounded) <= ann.EPSILON * levels.deviation[:, None] / scalars).mean() > 0.99
    true = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (data / np.linalg.norm(data, axis=1, keepdims=True)).T
    bound = levels.bound(scalars, ann.EPSILON)
    assert (np.abs(estimate - true) <= bound).mean() > 0.995
    assert abs((estimate - true).mean()) < 0.01


def test_hostile_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (50, [0.0, 1e-300]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (100, [1e300, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"row": F.lit("x"), "code": F.lit("y")})
    found = ann.search(ann.index(df), F.pmod("vec_id", F.lit(50)) == 0, 5)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert got[0][:2] == [2, 2] and set(got[0]) == {1, 2, 50, 100} and len(got[0]) == 5
    assert ann.search(ann.index(df.limit(0)), F.col("vec_id") == 0, 5).count() == 0


def test_every_length_is_searched_by_itself(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    vectors = {i: r.standard_normal((3, 70, 128)[i % 3]).astype(np.float32).tolist() for i in range(900)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>").repartition(3)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in ann.search(ann.index(df), F.pmod("vec_id", F.lit(50)) == 0, 5).collect()}
    hits = 0
    for rest in range(3):
        alike = {i: v for i, v in vectors.items() if i % 3 == rest}
        want = nearest(alike, [q for q in range(0, 900, 50) if q % 3 == rest], 5)
        hits += sum(got[q, rank] == (i, s) for q, rank, i, s in want)
    assert len(got) == 90 and hits >= 85


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=fst.MODEL_PATH)


def test_encoding_equals_the_library(library):
    r = random.Random(1)
    transducer = fst.compiled(fst.read_model())
    alphabet = "abtheiné\n\tx▁中\U0001f600ﬁA.,1'  \u0000"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 8))) for _ in range(4000)]
    texts += [" " * k for k in range(40)] + [" " * k + "the" for k in range(20)] + ["a" * 3000, "the" * 100, "é" * 100, "\r\n"]
    ids = transducer.encode(texts)
    assert ids.to_pylist() == library.encode(texts)
    assert transducer.decode(ids) == [t.replace("▁", " ") for t in texts]
    assert transducer.decode(ids) == [library.decode(x) for x in library.encode(texts)]


def test_unigram_paths_are_the_cheapest():
    model = fst.Model(["<unk>", "▁", "a", "b", "ab", "ba", "aba"], [0, -2.0, -1.0, -1.5, -1.2, -2.0, -1.9], [2] + [1] * 6, fst.UNIGRAM, True)
    transducer = fst.Transducer(model)

    def best(text):
        if not text:
            return 0.0
        return min(best(text[len(p) :]) - s for p, s in zip(model.pieces[1:], model.scores[1:]) if text.startswith(p)) if text else 0.0

    r = random.Random(0)
    for _ in range(60):
        word = "▁" + "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        ids = transducer.encode([word[1:]])[0].as_py()
        assert "".join(model.pieces[i] for i in ids) == word
        assert abs(-sum(model.scores[i] for i in ids) - best(word)) < 1e-5


def test_a_long_word_takes_the_same_path(library):
    transducer = fst.compiled(fst.read_model())
    word = "▁" + "".join(random.Random(2).choice("thenréationingx") for _ in range(60))
    points = np.array([[ord(c) for c in word]])
    path = transducer.shortest_paths(points)[0]
    assert transducer._long(word).tolist() == path[path >= 0].tolist() == library.encode(word[1:])


def test_encoding_hostile_rows(hostile, nothing, library):
    model = fst.read_model()
    coded = fst.decode(fst.encode(hostile, model, output="pieces"), model, "pieces", output="back").collect()
    assert len(coded) == len(HOSTILE)
    for row in coded:
        assert row["pieces"] == library.encode(row["text"] or "")
        assert row["back"] == (row["text"] or "").replace("▁", " ")
    once = fst.encode_and_decode(hostile, model, ids_output="pieces", text_output="back").collect()
    assert [(r["pieces"], r["back"]) for r in once] == [(r["pieces"], r["back"]) for r in coded]
    assert fst.encode(nothing, model).count() == 0 and fst.encode_and_decode(nothing, model).count() == 0
    assert fst.compiled(model).decode(pa.array([None, [], [0], [1, 2]], pa.list_(pa.int32()))) == [None, "", "�", ""]


def test_pipeline_against_its_parts(spark, library):
    """Quality as scored; then exact, near duplicates, the mix and ids against plain Python."""
    from rankjobs.llm import quality
    from tests.llm.test_exact_dedup import expected
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in quality.score_documents(docs, model).collect() if r["score"] >= quality.THRESHOLD]
    kept = {e[0] for e in expected([(i, t) for i, t, _ in rows]) if e[3]}
    rows = [r for r in rows if r[0] in kept]
    first = {}
    for i, _, group, _ in brute([(i, t) for i, t, _ in rows]):
        first[group] = min(first.get(group, i), i)
    rows = [r for r in rows if r[0] in first.values()]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    result = corpus_pipeline.run(spark, SF_DIR).collect()
    texts = {i: t for i, t, _ in rows}
    taken = {}
    for r in result:
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"])
        taken[r["source"]] = taken.get(r["source"], 0) + len((texts[r["doc_id"]] or "").split())
    total = sum(sizes.values())
    assert abs(sum(taken.values()) - total) < 0.25 * total
    assert all(taken[s] <= 3 * sizes[s] for s in taken)


def test_every_stage_takes_hostile_rows_and_none(spark, hostile, nothing, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, hostile, str(tmp_path))
        assert 0 < out.count() <= 3 * len(HOSTILE), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == hostile.columns, name
        assert step(spark, nothing, str(tmp_path)).count() == 0, name


def test_last_stage_decodes_what_it_encodes(spark, hostile, tmp_path):
    out = corpus_pipeline.encode_pieces(spark, hostile, str(tmp_path)).collect()
    assert len(out) == len(HOSTILE) and all(r["round_trip"] for r in out)


def test_registered(spark):
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names
    assert os.path.exists(fst.MODEL_PATH) and jaccard.WORDS == 5 and jaccard.THRESHOLD == 0.8
