from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from rankjobs.llm import perplexity
from tests.llm.conftest import HOSTILE, SCHEMA, sentence

WORD = re.compile("[^\x20\x09-\x0d]+")


class SlowModel:
    """Interpolated modified Kneser-Ney over the symbols of words, with dictionaries."""

    def __init__(self, words: Counter, order: int):
        self.order = order
        raw = Counter()
        for word, found in words.items():
            n = found.bit_length()
            symbols = f" {word} "
            for i in range(1, len(symbols)):
                raw[symbols[max(0, i - order + 1) : i + 1]] += n
        self.levels = {order: {g: n for g, n in raw.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            fronts = defaultdict(set)
            for g in self.levels[k + 1]:
                fronts[g[1:]].add(g[0])
            self.levels[k] = {g: len(x) for g, x in fronts.items()} | {g: n for g, n in raw.items() if len(g) == k}
        self.discounts, self.contexts = {}, {}
        for k, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            found = [None if y is None or not n[i] else i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            d = [f if f is not None and 0 < f <= i else i / 2 for i, f in enumerate(found, 1)]
            self.discounts[k] = d
            for g, c in level.items():
                total, given = self.contexts.get(g[:-1], (0, 0.0))
                self.contexts[g[:-1]] = (total + c, given + d[min(c, 3) - 1])

    def p(self, gram: str) -> float:
        if not gram:
            return 1 / (len(self.levels[1]) + 1)
        k, lower = len(gram), self.p(gram[1:])
        if gram[:-1] not in self.contexts:
            return lower
        total, given = self.contexts[gram[:-1]]
        count = self.levels[k].get(gram, 0)
        own = (count - self.discounts[k][min(count, 3) - 1]) / total if count else 0.0
        return own + given / total * lower

    def loss(self, word: str) -> float:
        symbols = f" {word} "
        return -sum(math.log(self.p(symbols[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(symbols)))


def slow_measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def drawn(n, seed=1):
    r = random.Random(seed)
    letters = {"en": "abcdefg", "de": "bcdäöüß", None: "xyz中é😀"}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", None])
        words = ["".join(r.choices(letters[lang], weights=range(1, len(letters[lang]) + 1), k=r.randint(1, 8))) for _ in range(r.randint(0, 90))]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(words), lang, "s", None))
    return rows


def slow_losses(rows, order):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        counts[lang or ""].update(WORD.findall(text or ""))
    models = {lang: SlowModel(words, order) for lang, words in counts.items()}
    seen = {}
    for _, text, lang, *_ in rows:
        for word in WORD.findall(text or ""):
            if (lang, word) not in seen:
                seen[lang, word] = models[lang or ""].loss(word)
    return [sum(seen[lang, w] for w in WORD.findall(text or "")) for _, text, lang, *_ in rows]


@pytest.mark.parametrize("settings", [{}, {"slice_rows": 700, "model_bytes": 20_000}, {"order": 3}])
def test_losses_against_dictionaries(spark, settings):
    rows = drawn(100)
    got = {r["doc_id"]: r for r in perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(4), **settings).collect()}
    assert len(got) == len(rows)
    for row, loss in zip(rows, slow_losses(rows, settings.get("order", 5))):
        r = got[row[0]]
        assert r["loss"] == pytest.approx(loss, rel=1e-6, abs=1e-9)
        measures = slow_measures(row[1])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == measures
        n = measures[0] + measures[1]
        assert r["perplexity"] == (pytest.approx(math.exp(loss / n), rel=1e-6) if n else None)


def test_probabilities_sum_to_one():
    model = SlowModel(Counter("ab abc abd ba bab abc cab".split()), 4)
    symbols = [*"abcd ", "?"]
    for context in ("", " ", "a", " a", "ab", " ab", "ba"):
        assert sum(model.p(context + s) for s in symbols) == pytest.approx(1)


def test_texts_the_model_has_not_seen(spark):
    rows = drawn(80)
    model = perplexity.fit(spark.createDataFrame(rows, SCHEMA), slice_rows=100)
    words = Counter(w for _, t, lang, *_ in rows if lang == "en" for w in WORD.findall(t))
    new = [(1, "abcx zzz a gfedcba QQ", "en", "s", 1), (2, "abc", "xx", "s", 1)]
    got = {r["doc_id"]: r for r in perplexity.measure(spark.createDataFrame(new, SCHEMA), model).collect()}
    slow = SlowModel(words, 5)
    assert got[1]["loss"] == pytest.approx(sum(slow.loss(w) for w in new[0][1].split()), rel=1e-6)
    assert got[2]["loss"] == 0 and got[2]["n_words"] == 1


def test_small_buffers_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    rows = drawn(60, seed=4)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "text": [(r[1] or "").encode() for r in rows]})

    def total():
        out = Counter()
        for b in perplexity._count_words(iter([batch])):
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, word] += n
        return out

    whole = total()
    monkeypatch.setattr(perplexity, "HELD_WORDS", 5)
    assert total() == whole


def test_bands_reject_strange_texts_and_ignore_copies(spark):
    r = random.Random(3)

    def text(alphabet, n=80):
        lexicon = ["".join(r.choices(alphabet, k=2 + i % 5)) + "en" for i in range(200)] if alphabet not in words else words[alphabet]
        words[alphabet] = lexicon
        return " ".join(r.choices(lexicon, weights=[1 / (i + 1) for i in range(200)], k=n))

    words: dict = {}

    rows = [(i, text("abcde"), "en", "s", 1) for i in range(120)]
    # a third of all rows are copies
    rows += [(200 + i, rows[0][1], "en", "s", 1) for i in range(60)]
    rows += [(900, text("vwxyzVWXYZ#%"), "en", "s", 1), (902, text("klmno"), "few", "s", 1)]
    got = {x["doc_id"]: x for x in perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert all(got[i]["kept"] for i in range(120)) and all(got[200 + i]["kept"] for i in range(60))
    assert not got[900]["kept"] and not got[900]["base_failed"]
    # a language with one text has no band
    assert got[902]["kept"]


def test_base_rules(spark):
    rows = [(1, sentence(49, 1)), (2, sentence(50, 1)), (3, ("same three words " * 26 + sentence(24, 2)).strip()), (4, None), (5, "a " * 60)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in perplexity.quality_rules(frame).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False), 4: (True, False), 5: (True, False)}


def test_hostile_rows(hostile, nothing):
    got = perplexity.quality_rules(hostile).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(((row[0], *slow_measures(row[1])) for row in HOSTILE), key=key)
    assert perplexity.quality_rules(nothing).count() == 0


def test_registered_query(spark):
    from rankjobs.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op13_perplexity"][0](spark, sf_dir)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert dict(rows.dtypes) == {"doc_id": "bigint", "base_failed": "boolean", "kept": "boolean", "perplexity": "double"} | dict.fromkeys(counts, "bigint")
    want = {r["doc_id"]: slow_measures(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows.collect():
        assert tuple(r[c] for c in counts) == want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_clean_documents_stay(spark):
    from rankjobs.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op13_perplexity"][0](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    found = rows.join(labels, "doc_id").filter("NOT base_failed").groupBy("kept").count().collect()
    counts = {r["kept"]: r["count"] for r in found}
    assert counts[True] > 0.97 * sum(counts.values())
