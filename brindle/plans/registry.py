"""All queries of the retrieval engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dataset, dataset_sql, retrieval, training

FLAGSHIP = "two_stage_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in (retrieval, dataset, training) for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for all queries but those that are sequential, seeded draws, or hashes of Spark's own kind."""
    return {**retrieval.SQL, **dataset_sql.SQL, **training.SQL}
