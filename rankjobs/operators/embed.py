"""Text to vectors. The encoder is a plug-in; two come with the library."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankjobs.functions import text as tx
from rankjobs.functions.numeric import l2_normalize

# Texts whose tokens are counted at once inside a task.
TEXTS_AT_ONCE = 1024

# texts -> matrix with one row per text
Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    id_column: str,
    text_column: str,
    make_encoder: Callable[[], Encoder],
    *,
    batch_size: int = 32,
    as_query: bool = False,
) -> DataFrame:
    """``(id, embedding)`` of unit length, float32.

    ``make_encoder`` runs once per task and returns a function on a list of texts,
    so that a model is loaded per Python worker and never shipped. ``as_query`` puts
    the query prefix in front.
    """
    text = tx.query_text(text_column) if as_query else F.coalesce(F.col(text_column), F.lit(""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vectors = np.asarray(encode(part["text"].tolist()), dtype=np.float32)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
                yield pd.DataFrame({id_column: part[id_column].to_numpy(), "embedding": list(vectors)})

    return df.select(F.col(id_column).cast("bigint").alias(id_column), text.alias("text")).mapInPandas(
        run, f"{id_column} bigint, embedding array<float>"
    )


def token_hash_vectors(
    df: DataFrame, id_column: str, text_column: str, *, dim: int = 256, as_query: bool = False
) -> DataFrame:
    """Counts of hashed tokens, unit length: a vector for every text without a fitted model.

    The bucket of a token is the number in the first eight hex digits of its MD5,
    modulo ``dim``. Tokens are cut by Spark; a task hashes each distinct token of a
    batch once. Nothing is shuffled.
    """
    text = tx.query_text(text_column) if as_query else F.col(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, TEXTS_AT_ONCE) for b in batches for start in range(0, len(b), TEXTS_AT_ONCE)):
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            buckets = np.array(
                [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in coded.dictionary.to_pylist()],
                dtype=np.int64,
            )
            rows = np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths().to_numpy(), dtype=np.int64))
            cells = rows * dim + (buckets[coded.indices.to_numpy()] if len(coded) else rows)
            counts = np.bincount(cells, minlength=len(batch) * dim).reshape(len(batch), dim).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0).astype(np.float32)
            offsets = np.arange(0, (len(batch) + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))],
                names=[id_column, "embedding"],
            )

    return df.select(F.col(id_column).cast("bigint").alias(id_column), tx.tokenize(text).alias("tokens")).mapInArrow(
        run, f"{id_column} bigint, embedding array<float>"
    )


def tf_idf_vectors(corpus: DataFrame, id_column: str, text_column: str, *, dim: int = 1024, others: DataFrame | None = None):
    """Hashed TF-IDF vectors of unit length by Spark ML, fitted on the corpus.

    Returns the corpus vectors, and with ``others`` also theirs under the same fit.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def tokens(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("bigint").alias(id_column), tx.tokenize(text_column).alias("tokens"))

    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="unit"),
    ]
    model = Pipeline(stages=stages).fit(tokens(corpus))

    def vectors(df: DataFrame) -> DataFrame:
        return model.transform(tokens(df)).select(id_column, vector_to_array("unit", "float32").alias("embedding"))

    return vectors(corpus) if others is None else (vectors(corpus), vectors(others))


def unit_vectors(df: DataFrame, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """Stored vectors brought to unit length."""
    return df.select(F.col(id_column).cast("bigint").alias(id_column), l2_normalize(vector_column).alias("embedding"))


def rows_per_block(dim: int, block_bytes: int = 4 << 20) -> int:
    """Rows of float32 vectors that fit a block."""
    return max(1, min(4096, math.floor(block_bytes / (4 * max(1, dim)))))


def weights(vectors: DataFrame, id_column: str) -> DataFrame:
    """The positive elements of vectors in long form, to six decimals."""
    return vectors.select(id_column, F.posexplode("embedding").alias("bucket", "weight")).filter("weight > 0").select(
        id_column, F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("weight").cast("double"), 6).alias("weight")
    )
