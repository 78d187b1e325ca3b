"""The registered queries: a Spark job and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    from rankjobs.queries import evaluation, profiling, ranking, retrieval, sources, tables, texts, training

    entries: dict[str, tuple[Query, str | None]] = {}
    for module in (texts, tables, profiling, retrieval, ranking, evaluation, sources, training):
        entries.update(module.QUERIES)
    return entries
