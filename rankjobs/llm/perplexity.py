"""Quality rules: repetition, and the perplexity of texts in an n-gram model of their language.

1. Words are runs without white space. Tasks count the words of each language, Spark sums
   them up. A word found n times weighs 1 + floor(log2(n)), so that copies and near copies of
   a text, even a third of all rows, cannot teach the model their own words. A word stands
   between two boundary symbols; each of its characters and its end are predicted from up to
   ``order - 1`` symbols before, within the word. The n-grams of the weighted words are the
   counts of the highest order, and of grams at a word's start.
2. Counts of lower orders are numbers of different symbols in front (Kneser-Ney). Each order
   of each language has three discounts, from its numbers of counts 1 to 4 (modified).
   Probabilities are interpolated order by order, in joins of narrow tables.
3. The model is stored per language, and in slices of a large language, as sorted arrays of
   gram hashes with log probabilities and of context hashes with log back-off weights.
   A slice has everything for positions whose last two symbols before fall into it.
4. The arrays are broadcast. Tasks score each distinct word once, by binary search, longest
   gram first, and add up the words of each text: its mean log loss per symbol.
5. Per language, the quartiles of the mean loss over all different losses of texts that pass
   the repetition rules give the band: ``FENCE`` times their distance beyond each quartile.
   Texts outside are rejected: below it text repeats itself or is made of few symbols,
   above it is not the language.

Memory: a broadcast holds at most ``model_bytes``. A larger model is taken in rounds; the
losses of the rounds are added up by row (then the texts are numbered and written once).
Tasks hold ``HELD_WORDS`` distinct words (what is shuffled are distinct words of a task; in
writing without spaces these are nearly the texts). A slice has about ``slice_rows`` grams and contexts.

Defined results: a null text is an empty text, which has no words and fails the rules; a null
language counts as ''. Languages with fewer than ``LEAST_TEXTS`` different losses have no
band, so only the rules decide there. Copies have equal losses and so count once in a band.
The perplexity of a text without words is null. An empty table gives an empty result. Other
columns do not matter. 64-bit hashes stand for grams; equal ones would share a probability.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankjobs.sources.artifacts import stage

ORDER = 5
HELD_WORDS = 1 << 18
AT_ONCE = 1 << 20  # bytes of text that a task splits into words at once
SLICE_ROWS = 1 << 20
MODEL_BYTES = 96 << 20
LEAST_TEXTS = 30
FENCE = 3.0
LEAST_SPREAD = 0.02
BIN = 1000
LEAST_WORDS = 50

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
INNER = SPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that go on with a character

WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
PACKED = "lang string, slice int, model binary"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, loss double"


# ---------------------------------------------------------------- symbols and hashes


@dataclass
class Symbols:
    """The symbols of some words, each word between two boundaries (spaces)."""

    text: str
    codes: np.ndarray  # code points as 64 bits
    word: np.ndarray  # of each predicted symbol: its word,
    at: np.ndarray  # where it stands
    reach: np.ndarray  # and how many symbols of its word stand before it

    @staticmethod
    def of(words: list[bytes]) -> Symbols:
        text = (b" " + b"  ".join(words) + b" ").decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        edges = np.flatnonzero(codes == 32)
        starts = edges[0::2]
        word = np.repeat(np.arange(len(words)), edges[1::2] - starts + 1)
        reach = np.arange(len(codes)) - starts[word]
        at = np.flatnonzero(reach)
        return Symbols(text, codes, word[at], at, reach[at])


def _hashes(codes: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the grams of a length that end before the given places."""
    out = np.full(len(ends), length, dtype=np.uint64)
    for back in range(length, 0, -1):
        out = (out ^ codes[ends - back]) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


# ---------------------------------------------------------------- counts


def _repeated(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            columns = [_repeated(lang, len(words)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=WORDS)
        held.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = held.setdefault(lang, Counter())
            before = len(words)
            words.update(text.split())
            size += len(words) - before
            if size > HELD_WORDS:
                yield from flush()
                size = 0
    yield from flush()


def _count_grams(order: int):
    def grams(lang: str, words: list[bytes], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        symbols = Symbols.of(words)
        lengths = np.minimum(symbols.reach + 1, order)
        for length in range(2, order + 1):
            own = np.flatnonzero(lengths == length)
            ends = symbols.at[own] + 1
            _, first, which = np.unique(_hashes(symbols.codes, ends, length), return_index=True, return_inverse=True)
            texts = [symbols.text[e - length : e] for e in ends[first].tolist()]
            counts = np.bincount(which, weights=weights[symbols.word[own]], minlength=len(first)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_repeated(lang, len(first)), pa.array(texts, pa.string()), pa.array(counts)], schema=GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                own = batch.take(pa.array(np.flatnonzero(langs == lang)))
                yield from grams(lang, own.column("word").to_pylist(), own.column("weight").to_numpy().astype(np.float64))

    return run


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: how often a symbol follows its context, over the damped counts of all words."""
    words = texts.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n bigint")
    weights = words.groupBy("lang", "word").agg(F.length(F.bin(F.sum("n"))).cast("bigint").alias("weight"))
    counted = stage(weights, "words").mapInArrow(_count_grams(order), "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- modified Kneser-Ney


def _adjusted(raw: DataFrame, order: int) -> list[DataFrame]:
    """(lang, gram, n) for the lengths 1 to ``order``: raw counts at the top and at word starts, else different symbols in front."""
    levels = [stage(raw.filter(F.length("gram") == order), "grams-top")]
    for length in range(order - 1, 0, -1):
        fronts = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        starts = raw.filter((F.length("gram") == length) & F.col("gram").startswith(" "))
        levels.insert(0, stage(fronts.unionByName(starts.select("lang", "gram", "n")), f"grams-{length}"))
    return levels


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what counts of 1, 2 and more give away; half a count's share where the counts of counts do not tell."""
    n = {i: F.count(F.when(F.col("n") == i, 1)).cast("double") for i in range(1, 5)}
    found = level.groupBy("lang").agg(*(n[i].alias(f"n{i}") for i in n))
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def discount(i: int) -> Column:
        d = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.when((d > 0) & (d <= i), d).otherwise(F.lit(i / 2)).alias(f"d{i}")

    return found.select("lang", *(discount(i) for i in (1, 2, 3)))


def model_rows(raw: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, kind ('p' log probability, 'b' log back-off weight), length, gram, context, value."""
    rows, lower = [], None
    for length, level in enumerate(_adjusted(raw, order), start=1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        given = (
            level.join(_discounts(level), "lang")
            .withColumn("context", F.left("gram", F.lit(length - 1)))
            .withColumn("suffix", F.expr("substring(gram, 2)"))
            .withColumn("d", d)
        )
        contexts = stage(
            given.groupBy("lang", "context").agg(
                F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("back"), F.count(F.lit(1)).alias("grams")
            ),
            "contexts",
        )
        if lower is None:
            lower = contexts.select("lang", F.lit("").alias("suffix"), (1 / (F.col("grams") + 1.0)).alias("p_lower"))
            none = F.lit("").alias("gram"), F.lit("").alias("context")
            rows.append(lower.select("lang", F.lit("p").alias("kind"), F.lit(0).alias("length"), *none, F.log("p_lower").alias("value")))
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("p_lower")
        known = stage(
            given.join(contexts, ["lang", "context"]).join(lower, ["lang", "suffix"]).select("lang", "gram", "context", p.alias("p")),
            "probabilities",
        )
        rows.append(known.select("lang", F.lit("p").alias("kind"), F.lit(length).alias("length"), "gram", "context", F.log("p").alias("value")))
        rows.append(
            contexts.select(
                "lang", F.lit("b").alias("kind"), F.lit(length - 1).alias("length"), F.col("context").alias("gram"), "context", F.log("back").alias("value")
            )
        )
        lower = known.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- sorted hash arrays


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    tables = {}
    for (kind, length), part in rows.groupby(["kind", "length"]):
        codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        ends = (np.arange(len(part)) + 1) * int(length)
        hashes = _hashes(codes, ends, int(length))
        order = np.argsort(hashes)
        tables[kind, int(length)] = (hashes[order], part["value"].to_numpy(dtype=np.float32)[order])
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "slice": [rows["slice"].iloc[0]], "model": [pickle.dumps(tables)]})


@dataclass(frozen=True)
class Model:
    """lang, slice, model (sorted arrays), staged; the number of slices and the order."""

    packed: DataFrame
    slices: int
    order: int


def _texts(docs: DataFrame, text_column: str, lang_column: str) -> list[Column]:
    return [
        F.coalesce(F.col(f"`{lang_column}`"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"),
    ]


def fit(
    docs: DataFrame, *, order: int = ORDER, text_column: str = "text", lang_column: str = "lang", slice_rows: int = SLICE_ROWS
) -> Model:
    """Count all texts and store the model of every language."""
    raw = stage(gram_counts(docs.select(*_texts(docs, text_column, lang_column)), order), "grams")
    rows = stage(model_rows(raw, order), "model-rows")
    largest = rows.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    slices = -(-largest // slice_rows)
    dealt = F.pmod(F.ascii(F.expr("substring(context, -2, 1)")) * 31 + F.ascii(F.expr("substring(context, -1, 1)")), F.lit(slices))
    where = F.when(F.length("context") >= 2, F.array(dealt)).otherwise(F.sequence(F.lit(0), F.lit(slices - 1)))
    packed = rows.withColumn("slice", F.explode(where)).groupBy("lang", "slice").applyInPandas(_pack, PACKED)
    return Model(stage(packed, "model"), slices, order)


# ---------------------------------------------------------------- measures of texts


def _found(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is stored, and its value."""
    keys, values = table
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, values[at].astype(np.float64)


def word_losses(words: list[bytes], tables: dict[int, dict], slices: int, order: int) -> np.ndarray:
    """Negative log probability of each word, over the positions that the given slices hold."""
    symbols = Symbols.of(words)
    codes, at = symbols.codes, symbols.at
    dealt = np.where(symbols.reach >= 2, (codes[np.maximum(at - 2, 0)] * np.uint64(31) + codes[at - 1]) % np.uint64(slices), 0)
    out = np.zeros(len(at))
    for own_slice, table in tables.items():
        own = np.flatnonzero(dealt == own_slice)
        length = np.minimum(symbols.reach[own] + 1, order)
        for k in range(order, -1, -1):
            part = np.flatnonzero(length == k)
            if not len(part) or ("p", k) not in table:
                length[part] -= 1
                continue
            ends = at[own[part]] + 1
            known, value = _found(table["p", k], _hashes(codes, ends, k))
            out[own[part[known]]] -= value[known]
            left, ends = part[~known], ends[~known] - 1
            if len(left) and k:
                seen, weight = _found(table["b", k - 1], _hashes(codes, ends, k - 1))
                out[own[left[seen]]] -= weight[seen]
                length[left] -= 1
    return np.bincount(symbols.word, weights=out, minlength=len(words))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _measure(shared, langs: set[str], slices: int, order: int):
    @F.pandas_udf(MEASURES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models: dict[str, dict[int, dict]] = {}
        for (lang, own), packed in shared.value.items():
            models.setdefault(lang, {})[own] = pickle.loads(packed)
        losses: dict[str, dict[bytes, float]] = {lang: {} for lang in langs}

        def learn(lang: str, words: set[bytes]) -> None:
            known = losses[lang]
            if len(known) > HELD_WORDS:
                known.clear()
            fresh = [w for w in words if w not in known]
            if fresh:
                known.update(zip(fresh, word_losses(fresh, models[lang], slices, order).tolist()))

        def measured(lang: str, text: bytes, words: list[bytes]) -> tuple:
            lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
            chars = len(text.translate(None, INNER))
            loss = float(sum(map(losses[lang].__getitem__, words))) if lang in models else 0.0
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), chars + len(words), loss

        for batch_langs, texts in batches:
            out, held, size = [], [], 0
            # a few texts at a time: their words are many times as large as they are
            for i, (lang, text) in enumerate(zip(batch_langs, texts)):
                held.append((lang, text, text.split()))
                size += len(text)
                if size >= AT_ONCE or i == len(texts) - 1:
                    for own in {x[0] for x in held} & models.keys():
                        learn(own, {w for x in held if x[0] == own for w in x[2]})
                    out += [measured(*x) for x in held]
                    held, size = [], 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return run


def _rounds(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int]]]:
    out, held = [], 0
    for lang, own, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append((lang, own))
        held += size
    return out


def measure(
    docs: DataFrame,
    model: Model,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """doc_id, lang, the measures of MEASURES and perplexity, one row per text, staged."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), *_texts(docs, text_column, lang_column))
    sizes = model.packed.select("lang", "slice", F.length("model").alias("bytes")).orderBy("lang", "slice").collect()
    rounds = _rounds([tuple(r) for r in sizes], model_bytes) or [[]]
    if len(rounds) > 1:
        texts = stage(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    parts = []
    for wanted in rounds:
        keys = {(r["lang"], r["slice"]) for r in sizes} & set(wanted)
        packed = model.packed.filter(F.col("lang").isin(sorted({lang for lang, _ in keys}))) if keys else model.packed.limit(0)
        in_round = packed.filter(F.struct("lang", "slice").isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted(keys)])) if keys else packed
        shared = spark.sparkContext.broadcast({(r["lang"], r["slice"]): bytes(r["model"]) for r in in_round.collect()})
        run = _measure(shared, {lang for lang, _ in keys}, model.slices, model.order)
        parts.append(stage(texts.withColumn("m", run("lang", "text")).select(*(c for c in texts.columns if c != "text"), "m.*"), "measures"))
        shared.unpersist()
    scored = parts[0]
    if len(rounds) > 1:
        for part in parts[1:]:
            scored = scored.unionByName(part.select(*scored.columns))
        rest = [c for c in scored.columns if c not in ("row", "loss")]
        scored = scored.groupBy("row").agg(*(F.first(c).alias(c) for c in rest), F.sum("loss").alias("loss")).drop("row")
    mean = F.col("loss") / F.nullif(F.col("n_tokens"), F.lit(0))
    return stage(scored.withColumn("mean_loss", mean).withColumn("perplexity", F.exp("mean_loss")), "measured")


# ---------------------------------------------------------------- rules


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(measured: DataFrame, fence: float = FENCE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """lang, low, high: bounds of the mean loss, by the quartiles of the different losses of texts that pass the base rules."""
    different = measured.filter(~base_failed() & F.col("mean_loss").isNotNull()).groupBy("lang", "mean_loss").agg(F.lit(1).alias("one"))
    bins = different.groupBy("lang", F.floor(F.col("mean_loss") * BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    placed = bins.select("lang", "bin", upto.alias("upto"), total.alias("total"))
    lower, upper = (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) for q in (0.25, 0.75))
    quartiles = placed.groupBy("lang").agg((lower / BIN).alias("q1"), ((upper + 1) / BIN).alias("q3"), F.max("total").alias("total"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    return quartiles.filter(F.col("total") >= least_texts).select(
        "lang", (F.col("q1") - fence * spread).alias("low"), (F.col("q3") + fence * spread).alias("high")
    )


def judge(measured: DataFrame, band: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    inside = F.coalesce(F.col("mean_loss").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        measured.join(band, "lang", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("low", "high")
    )


def quality_rules(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    order: int = ORDER,
    slice_rows: int = SLICE_ROWS,
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Fit on all texts, measure all texts, judge all texts."""
    model = fit(docs, text_column=text_column, lang_column=lang_column, order=order, slice_rows=slice_rows)
    measured = measure(
        docs, model, id_column=id_column, text_column=text_column, lang_column=lang_column, model_bytes=model_bytes
    )
    return judge(measured, stage(bands(measured), "bands"))
