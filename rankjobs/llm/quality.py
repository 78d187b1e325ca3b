"""Text quality by a sparse rule ensemble.

1. Statistics of a text are Spark column expressions.
2. On a bounded sample of labelled rows (``ROWS_PER_CLASS`` per class, collected) shallow
   boosted trees are grown; every path from a root to a node is a conjunctive rule such
   as "symbol share above 0.2 and words at least 12".
3. A logistic model with lasso weights over the rules keeps few of them.
4. The kept rules are compiled into one Spark column, so scoring runs where the text is
   read, without Python and without a shuffle.

Defined results: a null text is an empty text, whose statistics are 0; without labelled
rows, or with one class only, the score is the share of ones (0.5 without rows) for all
texts; an empty table gives an empty result. Rows are scored one by one, so repeated
rows get equal scores and other columns are passed through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.labels import learning_sample

ROWS_PER_CLASS = 6000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 0.002
STEPS = 400
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text as doubles; all are 0 for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\n"), lambda x: x != "")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)

    def share_of(pattern: str) -> Column:
        return share(chars - F.length(F.regexp_replace(text, pattern, "")), chars)

    return {
        "chars": F.log1p(chars.cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "lines": F.log1p(F.size(lines).cast("double")),
        "word_length": share(chars, F.size(words)),
        "line_length": F.log1p(share(chars, F.size(lines))),
        "upper_share": share_of(r"\p{Lu}+"),
        "symbol_share": share_of(r"[^\p{L}\p{N}\s]+"),
        "digit_share": share_of(r"[0-9]+"),
        "pipe_share": share(chars - F.length(F.replace(text, F.lit("|"), F.lit(""))), chars),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "repeats": share(chars - F.length(F.regexp_replace(text, r"(?<!\S)(\S++)(?:\s\1(?!\S))++", "$1")), chars),
    }


@dataclass(frozen=True)
class Rule:
    """Statistics within bounds: ``low < value <= high`` for each (index, low, high)."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, low, high in self.bounds:
            out &= (x[:, i] > low) & (x[:, i] <= high)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for i, low, high in self.bounds:
            if low > -math.inf:
                out = out & (F.col(f"`{names[i]}`") > F.lit(low))
            if high < math.inf:
                out = out & (F.col(f"`{names[i]}`") <= F.lit(high))
        return out


def _narrowed(bounds: dict[int, tuple[float, float]], i: int, low: float, high: float) -> dict[int, tuple[float, float]]:
    old = bounds.get(i, (-math.inf, math.inf))
    return bounds | {i: (max(old[0], low), min(old[1], high))}


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], target: np.ndarray, depth: int, least: int):
    """One regression tree; returns its values for the rows and the bounds of every node."""
    values = np.zeros(len(x))
    paths: list[dict[int, tuple[float, float]]] = []

    def split(rows: np.ndarray, level: int, bounds: dict[int, tuple[float, float]]) -> None:
        if bounds:
            paths.append(bounds)
        y = target[rows]
        values[rows] = y.mean()
        if level == depth or len(rows) < 2 * least:
            return
        best = (1e-9, None, None)
        for i, e in enumerate(edges):
            if not len(e):
                continue
            n = np.bincount(codes[rows, i], minlength=len(e) + 1)
            s = np.bincount(codes[rows, i], weights=y, minlength=len(e) + 1)
            left_n, left_s = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            right_n, right_s = len(rows) - left_n, y.sum() - left_s
            allowed = (left_n >= least) & (right_n >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(allowed, left_s**2 / left_n + right_s**2 / right_n, -np.inf) - y.sum() ** 2 / len(rows)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], i, at)
        if best[1] is None:
            return
        _, i, at = best
        edge = float(edges[i][at])
        left = codes[rows, i] <= at
        split(rows[left], level + 1, _narrowed(bounds, i, -math.inf, edge))
        split(rows[~left], level + 1, _narrowed(bounds, i, edge, math.inf))

    split(np.arange(len(x)), 0, {})
    return values, paths


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees as rules, each once, in the order in which they appear."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    edges = [e[e < column.max()] for e, column in zip(edges, x.T)]
    codes = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    random = np.random.default_rng(seed)
    margin = np.zeros(len(x))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        sample = np.flatnonzero(random.random(len(x)) < 0.7)
        residual = y - 1 / (1 + np.exp(-margin))
        _, paths = _grow(x[sample], codes[sample], edges, residual[sample], depth, least=max(5, len(x) // 200))
        leaves = [Rule(tuple((i, *b) for i, b in sorted(p.items()))) for p in paths]
        rules.update(dict.fromkeys(leaves))
        step = np.zeros(len(x))
        for rule in leaves:  # deeper nodes come later and overwrite their parents
            inside = rule.holds(x)
            if inside.any():
                step[inside] = residual[inside].mean()
        margin += 2.0 * step
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; columns are scaled inside."""
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-6)
    z = ((r - mean) / scale).astype(np.float32)
    vector = np.random.default_rng(0).random(z.shape[1]).astype(np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        vector = z.T @ (z @ vector)
        vector /= max(float(np.linalg.norm(vector)), 1e-12)
    rate = 1 / (0.25 * max(float(np.linalg.norm(z @ vector)) ** 2 / len(z), 1e-6) * 1.1 + 0.25)
    w, b = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    old, ahead, t = w, w, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead.astype(np.float32) + b))) - y
        moved = ahead - rate * (z.T @ error.astype(np.float32)) / len(z)
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        b -= float(error.mean())
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, old = w + (last - 1) / t * (w - old), w
    weights = w / scale
    return weights, float(b - weights @ mean)


@dataclass(frozen=True)
class RuleEnsemble:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def margin(self) -> Column:
        """The weighted sum of the rules over columns named as the statistics."""
        out = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            out = out + F.when(rule.column(self.names), weight).otherwise(0.0)
        return out

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-F.least(F.greatest(self.margin(), F.lit(-30.0)), F.lit(30.0))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = self.intercept + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return RuleEnsemble(names, [], [], math.log((share + 1e-3) / (1 - share + 1e-3)))
    rules = tree_rules(x, y)
    if not rules:
        return RuleEnsemble(names, [], [], math.log((share + 1e-3) / (1 - share + 1e-3)))
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(np.float64)
    weights, intercept = lasso_logistic(r, y)
    kept = np.flatnonzero(np.abs(weights) > 1e-3)
    return RuleEnsemble(names, [rules[k] for k in kept], [float(weights[k]) for k in kept], intercept)


def with_statistics(docs: DataFrame, text_column: str = "text", prefix: str = "_stat_") -> tuple[DataFrame, list[str]]:
    stats = statistics(F.col(f"`{text_column}`"))
    return docs.withColumns({prefix + n: c for n, c in stats.items()}), [prefix + n for n in stats]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, **columns) -> RuleEnsemble:
    """Fit on at most ``rows_per_class`` labelled rows of each class outside the held-out fold."""
    sample, names = with_statistics(learning_sample(docs, labels, label, rows_per_class, **columns))
    rows = sample.select("doc_id", "label", *names).toPandas().sort_values("doc_id")
    x, y = rows[names].to_numpy(dtype=np.float64), rows["label"].to_numpy(dtype=np.float64)
    model = fit_rules(names, x, y)
    return model


def accepted_documents(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns as they are."""
    stats = statistics(F.col(f"`{text_column}`"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    kept = docs.select(row, *(c.alias(n) for n, c in zip(model.names, stats.values()))).filter(model.score() >= threshold)
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def score_documents(docs: DataFrame, model: RuleEnsemble, text_column: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    scored, names = with_statistics(docs, text_column)
    return scored.withColumn(output, model.score()).drop(*names)
