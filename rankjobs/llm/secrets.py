"""Secret scan: proposals by pattern, false positives removed by a random forest.

Proposals are PEM blocks of private keys, bearer values, keys in the format of a known
provider, values assigned to a name such as ``password``, and long runs of the characters
that keys and tokens are made of which hold a digit or mixed case. Each has features:

- length, share of digits and capitals, entropy, whether it is hexadecimal or base64;
- character transitions: mean log probability under a bigram model of ordinary words, and
  how often the character class changes;
- dictionary coverage: the share of it covered by frequent words of the corpus;
- path: whether the path or source names tests, examples, documents or settings;
- neighbouring words: a credential's name before it, an assignment or ``bearer``, quotes,
  and words that speak for another meaning (a digest, a commit, a placeholder);
- whether it is a PEM block or has a known format.

A random forest, trained here on labelled findings, turns them into a score. Where no
labelled findings are given, a rule (``weak_kinds``) labels the findings of all documents
outside the held-out fold: 0, or the kind of evidence in ``KINDS`` that speaks for a secret.
The forest is fit on at most ``FINDINGS_PER_KIND`` of each, picked by a hash. A kind without
a finding to learn from, and all kinds where one class is missing, are scored by the rule:
1 for a finding of such a kind, so that no result depends on whether there was one.

The bigram model and the dictionary come from the words of all documents: all character
pairs, and the words that make up at least ``DICTIONARY_SHARE`` of all words (and occur
twice), which are 1 / ``DICTIONARY_SHARE`` at most at any size. Defined results: a null text is empty and has no finding; where given
findings are of one class all scores are the share of positive ones (0 without findings); positions are
code points, the end excluded; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.labels import held_out
from rankjobs.sources.artifacts import stage, staged_scope

FINDINGS_PER_KIND = 8000
DICTIONARY_SHARE = 2e-6
TREES, DEPTH, LEAF = 30, 8, 3
THRESHOLD = 0.5
CONTEXT = 48

RUN_CHARS = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
ASSIGNED = re.compile(
    r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?\s{0,4}(?:=>|:=|={1,3}|:)\s{0,4}"
    r"(?:[\"']([^\s\"']*+)|([^\s\"'&]*+(?:&(?![\w.-]+=)[^\s\"'&]*+)*+))"
)
ASSIGNED_CHARS = 8
PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----)[\s\S])*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{16,}+)++)"
)
BEARER = re.compile(r"(?i)(?<![a-z])bearer\s{1,4}([A-Za-z0-9._~+/=-]{16,}+)")
BEARER_BEFORE = re.compile(r"(?i)(?<![a-z])bearer\s{1,4}\Z")
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_\w{22,}+|glpat-[\w-]{20,}+"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[\w-]{20,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|AIza[\w-]{35}(?![\w-])|npm_[A-Za-z0-9]{36}(?!\w)"
    r"|hf_[A-Za-z0-9]{30,}+|SG\.[\w-]{16,}+\.[\w-]{16,}+|(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+)"
)
FILLED = re.compile(r"(?i)example|dummy|placeholder|your[_-]|x{6}")
NAMES = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)")
OTHERS = re.compile(r"(?i)(?<![a-z])(?:example|dummy|sample|placeholder|checksum|sha\d*|md5|commit|digest|hash|uuid|version|license|http|www)")
TESTS = re.compile(r"(?i)test|example|sample|doc|fixture")
SETTINGS = re.compile(r"(?i)\.env|config|settings|\.ya?ml|\.ini|\.properties|secret|deploy")
WORD = re.compile(r"[^\W\d_]{4,}")
HEX = re.compile(r"[0-9a-fA-F]+")
BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")

FEATURES = (
    "length", "digits", "capitals", "entropy", "hex", "base64", "transitions", "class_changes", "coverage",
    "test_path", "settings_path", "name_before", "assigned", "quoted", "other_near", "format",
)
# evidence for a secret that the rule knows; 0 is none
KINDS = ("none", "assigned", "known", "bearer", "pem")


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: log probabilities of character pairs, and the frequent words."""

    pairs: dict[str, float]
    rare: float
    words: frozenset[str]
    heads: frozenset[str]  # the first four letters of the words

    @classmethod
    def of(cls, pairs: dict[str, int], words: list[str]) -> Language:
        singles = Counter()
        for pair, n in pairs.items():
            singles[pair[0]] += n
        logs = {p: math.log((n + 1) / (singles[p[0]] + 64)) for p, n in pairs.items()}
        return cls(logs, math.log(1 / (max(singles.values(), default=1) + 64)), frozenset(words), frozenset(w[:4] for w in words))

    def transitions(self, text: str) -> float:
        text = text.lower()
        return sum(self.pairs.get(text[i : i + 2], self.rare) for i in range(len(text) - 1)) / max(1, len(text) - 1)

    def coverage(self, text: str) -> float:
        """The share covered by dictionary words, taken greedily from the left, longest first."""
        text, covered, at = text.lower(), 0, 0
        while at < len(text) - 3:
            n = 0
            if text[at : at + 4] in self.heads:
                n = next((n for n in range(min(16, len(text) - at), 3, -1) if text[at : at + n] in self.words), 0)
            covered += n
            at += n or 1
        return covered / max(1, len(text))


def _apart(first: list[tuple[int, int]], then: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists (each sorted and without overlaps) but for what of the second overlaps the first."""
    out, k = list(first), 0
    for start, end in then:
        while k < len(first) and first[k][1] <= start:
            k += 1
        if k == len(first) or first[k][0] >= end:
            out.append((start, end))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int]]:
    """Spans without overlaps. Whole values come before the runs inside them; runs are cut where an assigned value begins."""
    cuts, assigned = [], []
    for m in ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        cuts.append((start, start))
        if m.lastindex == 2:
            end = start + len(m.group(2).rstrip(",;:.!?)]}>"))
        if end - start >= ASSIGNED_CHARS:
            assigned.append((start, end))
    spans = _apart([m.span() for m in PEM.finditer(text)], [m.span(1) for m in BEARER.finditer(text)])
    spans = _apart(_apart(spans, assigned), [m.span() for m in KNOWN.finditer(text)])
    walls, k = sorted(spans + cuts), 0
    runs = []
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(walls) and walls[k][1] < at:
            k += 1
        parts, i = [], k
        while i < len(walls) and walls[i][0] < end:
            parts.append((at, walls[i][0]))
            at = max(at, walls[i][1])
            i += 1
        for a, b in (*parts, (at, end)):
            run = text[a:b]
            if b - a >= RUN_CHARS and (
                any(c.isdigit() for c in run) or (run != run.lower() and run != run.upper() and run[1:] != run[1:].lower())
            ):
                runs.append((a, b))
    return sorted(spans + runs)


def describe(text: str, start: int, end: int, path: str | None, language: Language) -> list[float]:
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in value]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 2]
    return [
        math.log(n),
        sum(k == 0 for k in kinds) / n,
        sum(k == 1 for k in kinds) / n,
        -sum(x / n * math.log2(x / n) for x in counts.values()),
        float(HEX.fullmatch(value) is not None),
        float(BASE64.fullmatch(value) is not None),
        language.transitions(value),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        language.coverage(value),
        float(bool(path and TESTS.search(path))),
        float(bool(path and SETTINGS.search(path))),
        float(NAMES.search(before) is not None),
        float(before.rstrip(" \t\"'").endswith(("=", ":", "=>")) or BEARER_BEFORE.search(before) is not None),
        float(before.endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(OTHERS.search(before) is not None),
        float(PEM.fullmatch(value) is not None or KNOWN.fullmatch(value) is not None),
    ]


def weak_kind(text: str, start: int, end: int, features: list[float]) -> int:
    """The evidence in ``KINDS`` for a secret; a value that is filled in for one has none."""
    x = dict(zip(FEATURES, features))
    value = text[start:end]
    if value.startswith("-----BEGIN") and x["format"]:
        return KINDS.index("pem") if x["entropy"] >= 3.5 else 0
    if x["entropy"] < 2.5 or FILLED.search(value):
        return 0
    if x["format"]:
        return KINDS.index("known")
    if x["coverage"] >= 0.5 or not x["digits"]:
        return 0
    if BEARER_BEFORE.search(text[max(0, start - CONTEXT) : start]):
        return KINDS.index("bearer")
    return KINDS.index("assigned") if x["name_before"] and x["assigned"] and not x["other_near"] else 0


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), threshold, children, value."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    constant: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += value[at]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """Bootstrap samples, a random part of the features at each node, Gini splits; rarer labels weigh more."""
    if not len(y) or y.min() == y.max():
        return Forest([], float(y.mean()) if len(y) else 0.0)
    random = np.random.default_rng(seed)
    some = max(1, round(math.sqrt(x.shape[1]) * 1.5))
    classes = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    grown = []
    for _ in range(trees):
        sample = random.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            w = classes[rows]
            nodes.append([-1, 0.0, 0, 0, float((w * y[rows]).sum() / w.sum())])
            if level == depth or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
                return me
            best = (1e-12, -1, 0.0)
            for f in random.permutation(x.shape[1])[:some]:
                order = np.argsort(x[rows, f], kind="stable")
                v, w_sorted = x[rows, f][order], w[order]
                total, ones = np.cumsum(w_sorted), np.cumsum(w_sorted * y[rows][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut >= LEAF - 1) & (cut < len(rows) - LEAF)]
                if not len(cut):
                    continue
                lt, lo, rt, ro = total[cut], ones[cut], total[-1] - total[cut], ones[-1] - ones[cut]
                gain = lo**2 / lt + (lt - lo) ** 2 / lt + ro**2 / rt + (rt - ro) ** 2 / rt
                gain -= (ones[-1] ** 2 + (total[-1] - ones[-1]) ** 2) / total[-1]
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, v[cut[k]])
            if best[1] >= 0:
                goes_left = x[rows, best[1]] <= best[2]
                children = grow(rows[goes_left], level + 1), grow(rows[~goes_left], level + 1)
                nodes[me][:4] = [best[1], best[2], *children]
            return me

        grow(sample, 0)
        table = np.array(nodes)
        grown.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
    return Forest(grown)


def _path(docs: DataFrame, path_column: str | None) -> Column:
    return F.col(f"`{path_column}`").cast("string") if path_column and path_column in docs.columns else F.lit(None).cast("string")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) -> pair, n: a row for each distinct pair of a task."""
    pairs = Counter()
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist()):
            for a, b in zip(word, word[1:]):
                pairs[a + b] += n
    yield pa.RecordBatch.from_pydict({"pair": pa.array(list(pairs), pa.string()), "n": pa.array(list(pairs.values()), pa.int64())})


def corpus_language(docs: DataFrame, text_column: str = "text") -> Language:
    """The language model of all documents; words are runs of letters of any alphabet."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_column}`")), F.lit(r"(\p{L}{2,})"))).alias("word"))
    with staged_scope(docs.sparkSession):
        counts = stage(words.groupBy("word").count(), "secret-words")
        pairs = counts.mapInArrow(_pair_counts, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
        frequent = counts.filter((F.col("count") >= max(2, math.ceil(DICTIONARY_SHARE * total))) & (F.length("word") >= 4))
        return Language.of({r["pair"]: r["n"] for r in pairs}, [r["word"] for r in frequent.select("word").collect()])


@dataclass
class Scanner:
    """``by_rule``: the kinds that the forest could not learn."""

    language: Language
    forest: Forest
    by_rule: frozenset[int] = frozenset()

    def score(self, features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.where(np.isin(kinds, list(self.by_rule)), 1.0, self.forest.predict(features))


def fit(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = "source",
    findings_per_kind: int = FINDINGS_PER_KIND, findings: tuple[np.ndarray, np.ndarray] | None = None,
) -> Scanner:
    """Language model of all documents, and a forest from findings of all documents outside the held-out fold."""
    language = corpus_language(docs, text_column)
    if findings is not None:
        return Scanner(language, fit_forest(*findings))
    doc_id = F.col(f"`{id_column}`")
    learning = docs.filter(~held_out(doc_id)).select(
        doc_id.alias("_id"), F.col(f"`{text_column}`").alias("text"), _path(docs, path_column).alias("path")
    )
    with staged_scope(docs.sparkSession):
        found = stage(_described(learning, language).withColumn("h", F.xxhash64("_id", "start")), "secret-findings")
        rows = []
        for kind, n in found.groupBy("kind").count().collect():
            # the smallest hashes; a threshold on them leaves few rows to sort at any size
            share = (findings_per_kind + 8 * math.sqrt(findings_per_kind) + 64) / n
            low = found.filter((F.col("kind") == kind) & (F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))))
            rows += low.orderBy("h", "_id", "start", "end").limit(findings_per_kind).select("features", "kind").collect()
    x = np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES))
    kinds = np.array([r["kind"] for r in rows], np.int64)
    secret = frozenset(range(1, len(KINDS)))
    if not (kinds == 0).any() or not (kinds > 0).any():
        return Scanner(language, Forest([]), secret)
    return Scanner(language, fit_forest(x, (kinds > 0).astype(np.int64)), secret - frozenset(kinds.tolist()))


def _described(docs: DataFrame, language: Language) -> DataFrame:
    """(_id, text, path) -> _id, start, end, kind, features of every proposal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, path in zip(*(batch.column(c).to_pylist() for c in ("_id", "text", "path"))):
                for start, end in proposals(text or ""):
                    x = describe(text, start, end, path, language)
                    out.append({"_id": key, "start": start, "end": end, "kind": weak_kind(text, start, end, x), "features": x})
            yield pa.RecordBatch.from_pylist(
                out,
                pa.schema([("_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("features", pa.list_(pa.float64()))]),
            )

    return docs.select(F.col("_id").cast("bigint"), "text", "path").mapInArrow(
        run, "_id bigint, start int, end int, kind int, features array<double>"
    )


FOUND = "array<struct<start:int,end:int,score:double>>"
FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan(
    docs: DataFrame, scanner: Scanner, *, text_column: str = "text", path_column: str | None = "source",
    output: str = "secrets", threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with the findings (start, end, score) of each text whose score reaches the threshold."""

    @F.arrow_udf(FOUND)
    def secrets(texts: pa.Array, paths: pa.Array) -> pa.Array:
        spans, features, kinds, out = [], [], [], []
        texts = texts.to_pylist()
        for k, (text, path) in enumerate(zip(texts, paths.to_pylist())):
            out.append([])
            for start, end in proposals(text or ""):
                spans.append((k, start, end))
                features.append(describe(text, start, end, path, scanner.language))
                kinds.append(weak_kind(text, start, end, features[-1]))
        if spans:
            for (k, start, end), p in zip(spans, scanner.score(np.array(features), np.array(kinds)).tolist()):
                if p >= threshold:
                    out[k].append({"start": start, "end": end, "score": round(p, 6)})
        return pa.array(out, type=FOUND_ARROW)

    return docs.withColumn(output, secrets(F.col(f"`{text_column}`"), _path(docs, path_column)))
