"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are characters (the mean of vectors of its hashed character n-grams,
with marks at its ends) and the word itself (a vector of its hash). A window of ``WINDOW``
words runs through a gated recurrent unit in both directions; attention weighs the states
and a linear layer gives the window's logit. All windows of the whole text are scored,
``STRIDE`` words apart, so that each overlaps the next. A logistic layer over the
largest logit, the sum of the windows' probabilities and the number of windows gives the
score of the document.

Training (in numpy, on the driver) uses at most ``ROWS_PER_CLASS`` labelled documents of
each class outside the held-out fold. A label belongs to a document, so the windows it
stands for are found on the way: first any windows of the document, then those that the
network scores highest.

Scoring works on Arrow batches in tasks; a batch is cut into slices of some megabytes.
What depends on the word alone is computed once for each distinct word of a slice.

Defined results: null and empty texts have no window, their score is that of the document
layer on zeros; without labelled rows, or with one class only, all scores are the share of
ones (0.5 without rows); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.labels import learning_sample

ROWS_PER_CLASS = 1500
WINDOW, STRIDE = 24, 8
GRAMS = (3, 5)
GRAM_ROWS = WORD_ROWS = 1 << 14
CHARACTER, WORD, HIDDEN, ATTENTION = 10, 6, 8, 8
EPOCHS, BATCH, RATE = 12, 128, 0.01
THRESHOLD = 0.5
SLICE_CHARS = 4 << 20
WORDS_AT_ONCE = 20_000
WINDOWS_AT_ONCE = 1024
SCORE_DECIMALS = 6

TOKEN = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Distinct words as rows of hash tables.

    For each length in ``GRAMS``, the words' grams one after another and where each
    word's begin (one entry more than words); and the words' own rows.
    """

    grams: list[tuple[np.ndarray, np.ndarray]]
    own: np.ndarray

    def part(self, ids: np.ndarray) -> Words:
        grams = []
        for rows, firsts in self.grams:
            n = firsts[ids + 1] - firsts[ids]
            begins = np.concatenate([[0], np.cumsum(n)])
            grams.append((rows[np.arange(begins[-1]) - np.repeat(begins[:-1] - firsts[ids], n)], begins))
        return Words(grams, self.own[ids])

    def counts(self) -> np.ndarray:
        """Grams of each word; a marked word has at least one of three characters."""
        return sum(np.diff(firsts) for _, firsts in self.grams)


def hashed_words(words: list[str]) -> Words:
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    powers = np.cumprod(np.full(max(max(GRAMS), int(lengths.max(initial=1))), _FACTOR, np.uint64))
    grams = []
    for n in GRAMS:
        counts = np.maximum(lengths - n + 1, 0)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(firsts[-1]) + np.repeat(starts[:-1] - firsts[:-1], counts)
        sums = np.full(len(at), n, np.uint64)
        for place in range(n):
            sums += points[at + place] * powers[place]
        grams.append(((_mixed(sums) & np.uint64(GRAM_ROWS - 1)).astype(np.int32), firsts))
    inside = np.arange(len(points)) - np.repeat(starts[:-1], lengths)
    own = np.add.reduceat(points * powers[inside], starts[:-1]) if len(words) else np.empty(0, np.uint64)
    return Words(grams, (_mixed(own) & np.uint64(WORD_ROWS - 1)).astype(np.int32))


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): the sums of the values with each row number."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x):
    out = np.exp(-x)
    out += 1
    return np.divide(1, out, out=out) if isinstance(out, np.ndarray) else 1 / out


def new_parameters(seed: int = 5) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (random.standard_normal(shape) * scale).astype(np.float32)

    d, h = CHARACTER + WORD, HIDDEN
    p = {"grams": normal(GRAM_ROWS, CHARACTER, scale=0.3), "words": normal(WORD_ROWS, WORD, scale=0.1)}
    for way in "fb":
        p |= {
            f"{way}_in": normal(d, 3 * h, scale=1 / math.sqrt(d)), f"{way}_state": normal(h, 3 * h, scale=1 / math.sqrt(h)),
            f"{way}_bias": np.zeros(3 * h, np.float32),
        }
    return p | {
        "attend": normal(2 * h, ATTENTION, scale=1 / math.sqrt(2 * h)), "attend_bias": np.zeros(ATTENTION, np.float32),
        "attend_out": normal(ATTENTION, scale=1 / math.sqrt(ATTENTION)), "out": normal(2 * h, scale=1 / math.sqrt(2 * h)),
        "out_bias": np.zeros(1, np.float32),
    }


def word_inputs(p: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """(words, CHARACTER + WORD): the mean over a word's grams, and its own vector."""
    out = np.zeros((len(words.own), CHARACTER + WORD), p["grams"].dtype)
    for start in range(0, len(out), WORDS_AT_ONCE):
        end = min(len(out), start + WORDS_AT_ONCE)
        for rows, firsts in words.grams:
            firsts = firsts[start : end + 1]
            some = np.flatnonzero(firsts[1:] > firsts[:-1])
            if len(some):
                vectors = p["grams"][rows[firsts[0] : firsts[-1]]]
                out[start + some, :CHARACTER] += np.add.reduceat(vectors, firsts[some] - firsts[0], axis=0)
    out[:, :CHARACTER] /= words.counts()[:, None]
    out[:, CHARACTER:] = p["words"][words.own]
    return out


def _run(gates: np.ndarray, state: np.ndarray, mask: np.ndarray, keep: list | None):
    """States (steps, windows, HIDDEN) of one direction; gates are the inputs' part, in the order of reading."""
    h = HIDDEN
    steps, n = mask.shape
    states = np.empty((steps, n, h), gates.dtype)
    last = np.zeros((n, h), gates.dtype)
    for t in range(steps):
        from_state = last @ state
        zr = sigmoid(gates[t][:, : 2 * h] + from_state[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(gates[t][:, 2 * h :] + r * from_state[:, 2 * h :])
        now = new + z * (last - new)
        if not mask[t].all():
            now = np.where(mask[t][:, None], now, last)
        if keep is not None:
            keep.append((last, z, r, new, from_state[:, 2 * h :]))
        states[t] = last = now
    return states


def forward(p: dict[str, np.ndarray], projected: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray, memory: dict | None = None):
    """Logits of windows. ``ids`` and ``mask`` are (WINDOW, windows); ``projected`` has each word's gate inputs for both ways."""
    kept_f, kept_b = ([], []) if memory is not None else (None, None)
    ahead = _run(projected[0][ids], p["f_state"], mask, kept_f)
    back = _run(projected[1][ids[::-1]], p["b_state"], mask[::-1], kept_b)[::-1]
    states = np.concatenate([ahead, back], axis=2)
    hidden = np.tanh(states @ p["attend"] + p["attend_bias"])
    energy = np.where(mask, hidden @ p["attend_out"], -1e9)
    weights = np.exp(energy - energy.max(axis=0))
    weights /= weights.sum(axis=0)
    pooled = (weights[:, :, None] * states).sum(axis=0)
    if memory is not None:
        memory.update(states=states, hidden=hidden, weights=weights, pooled=pooled, f=kept_f, b=kept_b)
    return pooled @ p["out"] + p["out_bias"]


def project(p: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return inputs @ p["f_in"] + p["f_bias"], inputs @ p["b_in"] + p["b_bias"]


def _back_run(d_states, state, mask, kept, d_gates):
    """Gradients of one direction into ``d_gates`` (steps, windows, 3 HIDDEN); returns that of the state matrix."""
    h = HIDDEN
    d_state = np.zeros_like(state)
    carry = np.zeros_like(d_states[0])
    for t in range(len(mask) - 1, -1, -1):
        last, z, r, new, from_new = kept[t]
        d = d_states[t] + carry
        live = mask[t][:, None]
        d_now = np.where(live, d, 0)
        d_new = d_now * (1 - z) * (1 - new**2)
        d_z = d_now * (last - new) * z * (1 - z)
        d_r = d_new * from_new * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_from = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_state += last.T @ d_from
        carry = np.where(live, d_now * z, d) + d_from @ state.T
    return d_state


def gradients(p, words: Words, ids: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Loss and gradients for windows over ``words`` (ids are rows of it)."""
    inputs = word_inputs(p, words)
    memory: dict = {}
    logits = forward(p, project(p, inputs), ids, mask, memory)
    loss = float(np.mean(np.logaddexp(0, logits) - y * logits))
    d_logit = ((sigmoid(logits) - y) / len(y)).astype(np.float32)
    states, hidden, weights, pooled = (memory[k] for k in ("states", "hidden", "weights", "pooled"))
    g = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["out"]
    d_weights = (states * d_pooled).sum(axis=2)
    d_energy = weights * (d_weights - (weights * d_weights).sum(axis=0))
    d_hidden = d_energy[:, :, None] * p["attend_out"] * (1 - hidden**2)
    g["attend_out"] = np.tensordot(d_energy, hidden, axes=([0, 1], [0, 1]))
    g["attend"] = np.tensordot(states, d_hidden, axes=([0, 1], [0, 1]))
    g["attend_bias"] = d_hidden.sum(axis=(0, 1))
    d_states = weights[:, :, None] * d_pooled + d_hidden @ p["attend"].T
    d_inputs = np.zeros_like(inputs)
    for way, part, order in (("f", slice(0, HIDDEN), slice(None)), ("b", slice(HIDDEN, None), slice(None, None, -1))):
        d_gates = np.empty((*mask.shape, 3 * HIDDEN), inputs.dtype)
        g[f"{way}_state"] = _back_run(d_states[order, :, part], p[f"{way}_state"], mask[order], memory[way], d_gates)
        by_word = row_sums(ids[order].ravel(), d_gates.reshape(-1, 3 * HIDDEN), len(inputs))
        g[f"{way}_in"] = inputs.T @ by_word
        g[f"{way}_bias"] = by_word.sum(axis=0)
        d_inputs += by_word @ p[f"{way}_in"].T
    d_characters = d_inputs[:, :CHARACTER] / words.counts()[:, None]
    rows = np.concatenate([r for r, _ in words.grams])
    owners = np.concatenate([np.repeat(np.arange(len(inputs)), np.diff(f)) for _, f in words.grams])
    g["grams"] = row_sums(rows, d_characters[owners], GRAM_ROWS)
    g["words"] = row_sums(words.own, d_inputs[:, CHARACTER:], WORD_ROWS)
    return loss, g


@dataclass
class Texts:
    """Texts as word numbers, with their windows."""

    words: Words
    ids: np.ndarray
    owner: np.ndarray  # of each window
    starts: np.ndarray  # of each window in ids
    sizes: np.ndarray  # words in each window
    n: int

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.arange(WINDOW)[:, None]
        mask = places < self.sizes[which]
        at = np.minimum(self.starts[which] + places, max(0, len(self.ids) - 1))
        return np.where(mask, self.ids[at], 0), mask


def read_texts(texts: list[str | None]) -> Texts:
    tokens = [TOKEN.findall((t or "").lower()) for t in texts]
    counts = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
    coded = pa.array([w for t in tokens for w in t], pa.string()).dictionary_encode()
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
    windows = np.where(counts > 0, np.ceil(np.maximum(counts - WINDOW, 0) / STRIDE).astype(np.int64) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * STRIDE
    return Texts(
        hashed_words(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64), owner,
        begins[owner] + offset, np.minimum(WINDOW, counts[owner] - offset), len(texts),
    )


def window_logits(p: dict[str, np.ndarray], texts: Texts) -> np.ndarray:
    projected = project(p, word_inputs(p, texts.words))
    out = np.empty(len(texts.owner), np.float64)
    for start in range(0, len(out), WINDOWS_AT_ONCE):
        part = np.arange(start, min(len(out), start + WINDOWS_AT_ONCE))
        out[part] = forward(p, projected, *texts.windows(part))
    return out


def pooled_features(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(texts, 3): largest logit, log of 1 + the sum of probabilities, log of 1 + windows; zeros without a window."""
    out = np.zeros((n, 3))
    count = np.bincount(owner, minlength=n)
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    some = count > 0
    out[some, 0] = np.clip(top[some], -15, 15)
    out[:, 1] = np.log1p(np.bincount(owner, weights=sigmoid(np.clip(logits, -30, 30)), minlength=n))
    out[:, 2] = np.log1p(count)
    return out


@dataclass
class Detector:
    parameters: dict[str, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    intercept: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.parameters:
            return np.full(len(texts), sigmoid(self.intercept))
        read = read_texts(texts)
        x = pooled_features(window_logits(self.parameters, read), read.owner, read.n)
        # later decimals of float32 products depend on what is multiplied along, and equal texts score alike
        return np.round(sigmoid(np.clip(x @ self.weights + self.intercept, -30, 30)), SCORE_DECIMALS)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):  # Newton
        q = sigmoid(np.clip(z @ w, -30, 30))
        step = np.linalg.solve((z.T * (q * (1 - q) + 1e-6)) @ z / len(z) + penalty, z.T @ (q - y) / len(z) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> Detector:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Detector(intercept=math.log((share + 1e-3) / (1 - share + 1e-3)))
    random = np.random.default_rng(seed)
    read = read_texts(texts)
    p = new_parameters()
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    label = y[read.owner]
    for epoch in range(epochs):
        # two windows of each text: any at first, then its highest, and for clean texts one of each
        chance = random.random(len(read.owner))
        order_by = chance if epoch < 3 else -window_logits(p, read)
        order = np.lexsort((order_by, read.owner))
        place = np.arange(len(order)) - np.searchsorted(read.owner[order], read.owner[order])
        picked = order[place < 2]
        if epoch >= 3:
            order = np.lexsort((chance, read.owner))
            place = np.arange(len(order)) - np.searchsorted(read.owner[order], read.owner[order])
            rest = order[(place < 2) & (label[order] == 0)]
            picked = np.unique(np.concatenate([picked, rest]))
        picked = random.permutation(picked)
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for start in range(0, len(picked), BATCH):
            which = picked[start : start + BATCH]
            ids, mask = read.windows(which)
            distinct, ids = np.unique(ids, return_inverse=True)
            _, g = gradients(p, read.words.part(distinct), ids.reshape(mask.shape), mask, label[which].astype(np.float32))
            step += 1
            for k, d in g.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    weights, intercept = _logistic(pooled_features(window_logits(p, read), read.owner, read.n), y)
    return Detector(p, weights, intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, **columns) -> Detector:
    """Train on at most ``rows_per_class`` labelled documents of each class outside the held-out fold."""
    rows = sorted(learning_sample(docs, labels, label, rows_per_class, **columns).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.float64))


def score_documents(docs: DataFrame, detector: Detector, text_column: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        out = [detector.score(texts.slice(a, b - a).to_pylist()) for a, b in zip(edges, edges[1:]) if b > a]
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(output, scores(F.col(f"`{text_column}`")))
