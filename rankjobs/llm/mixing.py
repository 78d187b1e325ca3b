"""Mix sources to target weights with hash-threshold histograms, in DataFrame functions only.

1. One pass over the text gives every document its size and a hash key.
2. The sources' weights are turned into target sizes. A target stops at
   ``max_repeats`` times its source's size; what it would have had beyond that is
   shared by weight among the others until none is above.
3. A target is so many whole passes over the source and a rest. The rest is the set
   of documents whose key lies below a threshold, found by nested histograms
   (``thresholds.cuts``); larger budgets take supersets of smaller ones.
4. Documents are kept by comparing their key with the threshold of their source.

Defined results: a null text has size 0; the null source is a source of its own, the
last one; documents of size 0 follow their key like others; a source of total size 0
has target 0 and is not taken; rows with equal id and text share a key and so the
number of copies; an empty table gives an empty result. A source's taken size differs
from its target by at most half of the size at the threshold (one document's, unless
rows repeat). Column names of the input do not matter besides the three named ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankjobs.llm.thresholds import cuts, hashed_key, numbered
from rankjobs.sources.artifacts import stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
KEY_BITS = 48
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_key(doc_id: Column, text: Column) -> Column:
    return hashed_key(doc_id, F.md5(F.coalesce(text, F.lit(""))), bits=KEY_BITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> (g, source, source_size, weight, target), one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    sources = stage(
        numbered(totals, order, "g").withColumn("weight", F.element_at(cycle, (F.pmod("g", F.lit(len(weights))) + 1).cast("int"))),
        "sources",
    )
    cap = F.col("source_size") * max_repeats
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped_size, free_weight = 0, None
    share = F.lit(0.0)
    while True:
        above = F.lit(False) if free_weight is None else share > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if (row.capped, row.free) == (capped_size, free_weight) or not row.free:
            break
        capped_size, free_weight = row.capped, row.free
        share = F.col("weight") * F.lit(float(total - capped_size)) / F.lit(float(free_weight))
    return sources.select("g", "source", "source_size", "weight", F.least(share, cap.cast("double")).alias("target"))


def mix_limits(
    docs: DataFrame,
    size: Column | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> tuple[DataFrame, DataFrame]:
    """The narrow table of sizes and keys, and per source its target and what is taken of it."""
    text = F.col(f"`{text_column}`")
    doc_id = F.col(f"`{id_column}`")
    sizes = stage(
        docs.select(
            doc_id.alias("doc_id"),
            F.col(f"`{source_column}`").alias("source"),
            mix_key(doc_id, text).alias("mix_key"),
            (word_count(text) if size is None else F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))).alias("size"),
        ),
        "mix-sizes",
    )
    sized = F.col("source_size") > 0
    passes = F.when(sized, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = stage(
        source_targets(sizes, weights, max_repeats)
        .withColumn("passes", passes)
        .withColumn("budget", F.when(sized, F.col("target") - F.col("passes") * F.col("source_size"))),
        "targets",
    )
    known = targets.select("g", F.col("source").alias("mix_source"), "source_size", "target", "passes")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("mix_source")))
    cut = cuts(
        rows.select("g", F.col("mix_key").alias("key"), F.col("size").alias("weight")), targets.select("g", "budget"), KEY_BITS
    )
    limits = known.join(cut, "g").withColumn("cut", F.when(F.col("source_size") > 0, F.col("cut")).otherwise(0)).drop("g")
    return sizes, stage(limits, "limits")


def copies_of(key: Column) -> Column:
    return F.col("passes") + F.when(key < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, size: Column | None = None, **settings) -> DataFrame:
    """doc_id, source, mix_key, size, source_size, target, copies, taken: one row per input row."""
    sizes, limits = mix_limits(docs, size, **settings)
    return (
        sizes.join(limits, F.col("source").eqNullSafe(F.col("mix_source")))
        .withColumn("copies", copies_of(F.col("mix_key")))
        .select(
            "doc_id", "source", "mix_key", "size", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, size: Column | None = None, **settings) -> DataFrame:
    """The input's rows and columns as the mix takes them: each row as many times as it has copies."""
    _, limits = mix_limits(docs, size, **settings)
    names = {"id_column": "doc_id", "text_column": "text", "source_column": "source"} | settings
    doc_id, text, source = (F.col(f"_docs.`{names[c]}`") for c in ("id_column", "text_column", "source_column"))
    limits = limits.select(F.struct("passes", "cut").alias("_limit"), F.col("mix_source").alias("_mix_source"))
    taken = docs.alias("_docs").join(limits.alias("_limits"), source.eqNullSafe(F.col("_limits._mix_source")))
    copies = F.col("_limits._limit.passes") + F.when(mix_key(doc_id, text) < F.col("_limits._limit.cut"), 1).otherwise(0)
    # an empty text lies below a cut without a rest, too
    copies = F.least(copies, F.lit(settings.get("max_repeats", MAX_REPEATS)))
    return (
        taken.select(F.explode(F.array_repeat(F.struct(*(F.col(f"_docs.`{c}`") for c in docs.columns)), copies)).alias("_row"))
        .select(*(F.col(f"_row.`{c}`") for c in docs.columns))
    )
