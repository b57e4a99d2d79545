"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import batch, streams  # noqa: F401  (streams registers its queries)


def entry_query(spark: SparkSession, folder: str) -> DataFrame:
    return batch.QUERIES["assess"](spark, folder)


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(batch.QUERIES)
