"""CSV, JSON and Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean "missing" in a CSV file.
NULL_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Raise ``ValueError`` naming the columns that ``df`` lacks; else return it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def with_column_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Derive a column only when the stored table does not have it."""
    return df if name in df.columns else df.withColumn(name, value)


def project_with_optional(df: DataFrame, required: Sequence[str], optional: dict[str, str]) -> DataFrame:
    """Required columns must exist; an absent optional one becomes a typed NULL."""
    require_columns(df, required)
    extra = [
        F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name) for name, kind in optional.items()
    ]
    return df.select(*required, *extra)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first of UTF-8, Windows-1252 and Latin-1 that can decode every byte of the file(s).

    Only one row of flags comes back; the bytes are looked at where they are read.
    Latin-1 has a letter for every byte, so the search always ends.
    """
    lines = spark.read.format("text").load(path).select(F.col("value").cast("binary").alias("raw"))
    # five bytes have no Windows-1252 letter
    no_cp1252 = F.hex("raw").rlike("^([0-9A-F]{2})*(81|8D|8F|90|9D)")
    flags = lines.agg(
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"),
        F.bool_or(no_cp1252).alias("has_unmapped"),
    ).first()
    if flags.utf8 is None or flags.utf8:
        return "UTF-8"
    return "ISO-8859-1" if flags.has_unmapped else "windows-1252"


# The Windows-1252 letters of 0x80-0x9F that exist, and their bytes as Latin-1 characters.
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_LETTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decode_cp1252(value: Column) -> Column:
    """Windows-1252 text out of Latin-1 text."""
    return F.translate(value, CP1252_BYTES, CP1252_LETTERS)


def encode_cp1252(value: Column) -> Column:
    """Latin-1 text whose bytes are the text in Windows-1252, for sinks that know Latin-1 only."""
    return F.translate(value, CP1252_LETTERS, CP1252_BYTES)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    required: Sequence[str] = (),
    encoding: str | None = None,
    null_words: Sequence[str] = NULL_WORDS,
) -> DataFrame:
    """A CSV table with a header; quoted cells may hold line ends and doubled quotes.

    With ``encoding=None`` the encoding is detected. Cells are matched to ``schema``
    by header name, and words that stand for a missing value become NULL.
    """
    encoding = encoding or detect_encoding(spark, path)
    from_latin1 = encoding == "windows-1252"
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "ISO-8859-1" if from_latin1 else encoding)
        .option("inferSchema", False)
        .csv(path)
    )
    first = raw.columns[0] if raw.columns else ""
    if first.startswith("\ufeff"):
        raw = raw.withColumnRenamed(first, first.lstrip("\ufeff"))
    wanted = [f.name for f in schema.fields] if schema else raw.columns
    require_columns(raw, required or wanted, path)

    def cell(name: str, kind: T.DataType) -> Column:
        text = F.col(f"`{name}`")
        text = decode_cp1252(text) if from_latin1 else text
        value = F.when(~text.isin(*null_words), text)
        if isinstance(kind, T.StringType):
            return value.alias(name)
        if isinstance(kind, (T.LongType, T.IntegerType)):
            # whole numbers do not pass through a double, which would change ids beyond 2^53
            return F.coalesce(value.try_cast(kind), value.try_cast("double").try_cast(kind)).alias(name)
        return value.try_cast(kind).alias(name)

    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    present = [n for n in wanted if n in raw.columns]
    return raw.select(*(cell(n, kinds.get(n, T.StringType())) for n in present))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with a header, also when there are no rows. Lists and structs become JSON text."""
    flat = df.select(
        *(
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )
    if flat.isEmpty():
        flat = flat.coalesce(1)
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; meant for one-row results such as a best configuration."""
    df.coalesce(1).write.mode(mode).json(path)


def sorted_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """JSON text of some columns with the keys in alphabetical order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
