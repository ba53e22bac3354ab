"""Data contracts as assertions on the rows that break them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def assert_empty(df: DataFrame, message: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise ContractError(f"{message}: {bad}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys of `wanted` that `there` lacks."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def assert_ratios(ratios: dict[str, float]) -> None:
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ContractError(f"ratios must be positive and sum to 1: {ratios}")


def assert_nested(smaller: DataFrame, larger: DataFrame, key: str) -> None:
    assert_empty(missing(smaller, larger, key), "subset isn't nested")


def assert_suite(suite: DataFrame, split: str) -> None:
    """An evaluation suite (image_id, split, is_query) has rows, all of `split` and with an id that occurs once, and a query.

    One pass counts what each rule needs."""
    bad = (F.col("split").isNull() | (F.col("split") != split) | F.col("image_id").isNull()).cast("long")
    got = suite.agg(F.count("*").alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.coalesce(F.max(F.col("is_query").cast("int")), F.lit(0)).alias("queries")).first()
    if not got.n:
        raise ContractError("the suite is empty")
    if got.bad:
        raise ContractError(f"{got.bad} rows of another split or without an id")
    if not got.queries:
        raise ContractError("the suite has no queries")
    assert_empty(duplicates(suite, "image_id"), "duplicate ids in the suite")


def assert_apart(*suites: DataFrame) -> None:
    """No id is in two suites."""
    ids = [s.select("image_id").distinct() for s in suites]
    assert_empty(duplicates(functools.reduce(DataFrame.unionByName, ids), "image_id"), "ids in several suites")


def assert_joined(pairs: DataFrame, rows: DataFrame, split: str = "train") -> DataFrame:
    """`pairs` (image_id, hard_id) with split and hard_split of their ends in `rows`; a missing end, or one that isn't in
    `split`, raises."""
    mine = rows.select("image_id", "split")
    other = rows.select(F.col("image_id").alias("hard_id"), F.col("split").alias("hard_split"))
    got = pairs.join(mine, "image_id", "left").join(other, "hard_id", "left")
    ends = got.select("image_id", "hard_id", "split", "hard_split")
    assert_empty(ends.where("split IS NULL OR hard_split IS NULL"), "ends of pairs are missing")
    assert_empty(ends.where((F.col("split") != split) | (F.col("hard_split") != split)), f"ends of pairs outside {split}")
    return got


def assert_report(metrics: DataFrame, names: tuple[str, ...]) -> None:
    """Metrics that go into a report table are of the report split and complete."""
    assert_empty(metrics.where("split IS NULL OR split <> 'report'"), "metrics of another split than report")
    lacking = [n for n in names if n not in metrics.columns]
    if lacking:
        raise ContractError(f"metrics are missing: {lacking}")
    assert_empty(metrics.where(functools.reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])), "metrics without a value")
