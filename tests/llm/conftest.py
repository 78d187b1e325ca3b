from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
EXTRA = (
    "row", "score", "size", "chunk", "fingerprint", "block", "unit", "shard", "key", "kept", "label", "_row", "_stat_chars",
    "_id", "spans", "ids", "copies", "g", "passes", "text_key", "path",
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


HOSTILE = [
    (1, sentence(60, 1), "en", "b", 1),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (None, sentence(20, 2), None, None, None),
    (None, sentence(20, 2), "de", "b", 5),
    (4, sentence(60, 1).replace(" ", "\n\t"), "en", "a", 3),
    (5, sentence(60, 1), "en", None, 3),
    (5, sentence(60, 1), "en", None, 3),
    (6, "x" * 200_000, "en", "c", 200_000),
    (7, sentence(20_000, 3), "fr", "c", 1),
    (8, "one two", "en", "c", 7),
    (9, "one two", "en", "c", 7),
    (10, "  \t\n ", "en", "b", 1),
    (11, "é x　中😀ﬁ ▁x \u0000 end", "", "", -1),
    (12, "mail a.b@c.example call +1 (017) 555-7713, from 10.0.0.1 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "b", 9),
]


@pytest.fixture(scope="session")
def hostile(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(HOSTILE, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in EXTRA}).cache()


@pytest.fixture(scope="session")
def nothing(hostile):
    return hostile.limit(0)


@pytest.fixture
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)

    return make
