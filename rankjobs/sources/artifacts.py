"""Intermediate tables in the shared checkpoint folder, and cached artifacts."""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rankjobs/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_scope: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def staged_scope(spark: SparkSession):
    """Tables staged inside are removed on the way out; frames that read them are to be used up by then."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove(spark, path)


def release_staged(spark: SparkSession) -> None:
    """Remove all tables this application has staged, when it no longer reads any."""
    remove(spark, application_folder(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    What follows no longer depends on the executors that computed it, its row
    grouping is fixed, and each later pass reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_key(df: DataFrame, settings: dict) -> str:
    """Sixteen hex digits over the settings, the schema and the content of ``df``."""
    digest = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s"),
    )
    row = digest.first()
    text = json.dumps([settings, df.columns, row.n, row.x, row.s], sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def cached_artifact(df: DataFrame, settings: dict, folder: str, build) -> DataFrame:
    """``build(df)``, stored under a key of settings and content; a stored one is reused."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(df, settings)}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the artifact as it is now, and how many rows were built, kept and removed."""

    rows: DataFrame
    built: int
    kept: int
    removed: int


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    numbers = [int(x.getPath().getName()) for x in system.listStatus(path) if x.getPath().getName().isdigit()]
    return sorted(n for n in numbers if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def refreshed_artifact(df: DataFrame, id_column: str, settings: dict, folder: str, build, keep_versions: int = 2) -> Refresh:
    """``build(df)``, where rows that the last version has already are taken from it.

    ``build`` works row by row: it takes rows of ``df``, with a bigint number as ``id_column``,
    and returns one row for each, with that number and other columns. A row is known by a hash over all its columns; new and changed
    rows are built, those that ``df`` has no longer leave. Rows that are equal in all columns
    are stored once; rows that share an id but differ are all stored. Other settings, another
    schema of ``df`` or a first call build everything.

    Each refresh writes a version of its own, which counts once it is complete, so one that
    is cut short changes nothing. ``keep_versions`` of them stay for readers of older ones.
    Hashes are compared in narrow tables; stored rows are joined with the hashes that left
    only, which Spark broadcasts where they are few, so a small change shuffles no stored row.
    """
    spark = df.sparkSession
    text = json.dumps([settings, df.schema.jsonValue()], sort_keys=True)
    base = f"{folder.rstrip('/')}/{hashlib.sha1(text.encode()).hexdigest()[:16]}"
    values = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_row_key", F.sha2(values, 256))
    wanted = stage(keyed.select("_row_key").distinct(), "wanted-keys")
    n_all = wanted.count()
    repeated = df.count() > n_all
    numbers = _versions(spark, base)
    target = f"{base}/{numbers[-1] + 1 if numbers else 1}"

    def built(rows: DataFrame) -> DataFrame:
        """One row per key; ``build`` sees a number in the place of the id."""
        if repeated:
            once = rows.groupBy("_row_key").agg(F.any_value(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("r"))
            rows = once.select("_row_key", "r.*")
        numbered = stage(rows.withColumn("_number", F.monotonically_increasing_id()), "rows-to-build")
        asked = numbered.drop("_row_key", id_column).withColumnRenamed("_number", id_column)
        out = build(asked.select(*(F.col(f"`{c}`") for c in df.columns)))
        names = numbered.select(F.col("_number"), "_row_key", F.col(f"`{id_column}`").alias("_id"))
        columns = [F.col("_id").alias(c) if c == id_column else F.col(f"`{c}`") for c in out.columns]
        return out.withColumnRenamed(id_column, "_number").join(names, "_number").select("_row_key", *columns)

    if not numbers:
        built(keyed).write.mode("overwrite").parquet(target)
        return Refresh(spark.read.parquet(target).drop("_row_key"), n_all, 0, 0)
    stored = spark.read.parquet(f"{base}/{numbers[-1]}")
    known = stored.select("_row_key")
    new = stage(wanted.join(known, "_row_key", "left_anti"), "new-keys")
    gone = stage(known.join(wanted, "_row_key", "left_anti"), "gone-keys")
    n_new, n_gone = new.count(), gone.count()
    if not n_new and not n_gone:
        return Refresh(stored.drop("_row_key"), 0, n_all, 0)
    fresh = built(keyed.join(new, "_row_key", "left_semi")) if n_new else stored.limit(0)
    stored.join(gone, "_row_key", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(target)
    for number in _versions(spark, base)[:-keep_versions]:
        remove(spark, f"{base}/{number}")
    return Refresh(spark.read.parquet(target).drop("_row_key"), n_new, n_all - n_new, n_gone)


def check_vectors(vectors: DataFrame, column: str = "embedding") -> int:
    """All vectors must be there, without NULL elements and of one length; returns the length."""
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(column)).alias("low"),
        F.max(F.size(column)).alias("high"),
        F.sum(F.when(F.col(column).isNull() | F.exists(column, lambda x: x.isNull()), 1).otherwise(0)).alias("bad"),
    ).first()
    if row.n and (row.bad or row.low != row.high):
        raise ValueError(f"expected vectors of one length, got {row.low} to {row.high} with {row.bad} incomplete rows")
    return row.high or 0


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    vectors = spark.read.parquet(path)
    check_vectors(vectors, column)
    return vectors
