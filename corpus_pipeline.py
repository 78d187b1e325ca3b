"""Documents to training data, in stages.

Every stage takes what its predecessor kept. All but the last return rows with the
columns of ``documents``; the last returns piece ids and whether they give the text back.

Rows with null texts count as empty texts, null sources as a source of their own; rows
with equal ids are rows like any other. An empty table passes through all stages. Extra
columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankjobs.llm import exact_dedup, jaccard, mixing, quality, sentencepiece_fst
from rankjobs.sources.artifacts import application_folder, staged_scope


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rule ensemble, fit on the labelled rows of the table's learning fold; rows below the threshold go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted_documents(docs, model)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.distinct_documents(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the smallest id stays."""
    return jaccard.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids, round_trip: whether the ids decode to the text."""
    coded = sentencepiece_fst.encode_and_decode(docs.select("doc_id", "source", "text"), sentencepiece_fst.read_model())
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_fst.MARK), F.lit(" "))
    return coded.select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_pieces"), "ids", (F.col("decoded") == plain).alias("round_trip")
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_filter),
    ("n-gram Jaccard join", near_dedup_filter),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

# the classifier, the pruned join and the transducer are beyond SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = f"{application_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        # what the step stages inside is removed when its result is written
        with staged_scope(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
