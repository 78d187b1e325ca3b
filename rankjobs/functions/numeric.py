"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankjobs.functions.text import as_col


def to_id(value: Column | str) -> Column:
    """Numbers and numeric text to an id, fractions cut off; anything else to NULL.

    Whole numbers never pass through a double, so ids beyond 2^53 stay exact.
    """
    value = as_col(value)
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def id_of(df: DataFrame, name: str) -> Column:
    """The id column of a table: as it is when it is integral already, which keeps
    filters on it pushable and large ids exact; else by ``to_id``."""
    integral = isinstance(df.schema[name].dataType, T.IntegralType)
    return F.col(name).cast("bigint") if integral else to_id(name)


def sigmoid(value: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(value)))


def min_max(value: Column | str, partition: Sequence[str]) -> Column:
    """Scale to [0, 1] within each list; a list of one value, or of equal values, is all 1."""
    value = as_col(value)
    window = Window.partitionBy(*partition)
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(value.isNull(), F.lit(None)).when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def with_min_max(rows: DataFrame, scaled: dict[str, str], by: Sequence[str]) -> DataFrame:
    """``min_max`` for lists of any length: new column -> column that is scaled within each list.

    Bounds come from an aggregation, which starts in each task, and are joined back; no
    window holds a list. ``rows`` is read twice, so it should be staged.
    """
    bounds = rows.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(
        *(f(v).alias(f"_{n}_{v}") for v in dict.fromkeys(scaled.values()) for n, f in (("low", F.min), ("high", F.max)))
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = rows.join(bounds, same)

    def scale(v: str) -> Column:
        low, high = F.col(f"_low_{v}"), F.col(f"_high_{v}")
        return F.when(F.col(v).isNull(), F.lit(None)).when(high > low, (F.col(v) - low) / (high - low)).otherwise(F.lit(1.0))

    return joined.withColumns({name: scale(v) for name, v in scaled.items()}).drop(*bounds.columns)


def l2_normalize(vector: Column | str) -> Column:
    """Unit-length array of floats; a zero vector stays zero."""
    vector = as_col(vector)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, (x / norm).cast("float")).otherwise(x.cast("float")))


def top_k(k: int) -> int:
    """A list always has room for one row."""
    return max(1, int(k))
