"""Small brute-force twins in plain Python, for fixtures of a few hundred rows."""

from __future__ import annotations

import math
import re
from collections import Counter


def bm25_scores(corpus: dict[int, str], query: str) -> dict[int, float]:
    """Okapi BM25 of every text for one query, by definition."""
    tokens = {i: re.findall(r"\w+", t.lower()) for i, t in corpus.items()}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for words in tokens.values() for t in set(words))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, words in tokens.items():
        tf = Counter(words)
        norm = 1.5 * (0.25 + 0.75 * len(words) / mean)
        out[i] = sum(idf.get(t, 0.0) * tf[t] * 2.5 / (tf[t] + norm) for t in re.findall(r"\w+", query.lower()))
    return out


def best(scores: dict[int, float], k: int, skip: int | None = None, decimals: int = 6, zeros: bool = False):
    rows = [(round(s, decimals), i) for i, s in scores.items() if i != skip and (zeros or round(s, decimals) != 0)]
    return [(i, s) for s, i in sorted(rows, key=lambda r: (-r[0], r[1]))[:k]]


def dot_scores(corpus: dict[int, list[float]], query: list[float]) -> dict[int, float]:
    return {i: sum(a * b for a, b in zip(v, query)) for i, v in corpus.items()}
