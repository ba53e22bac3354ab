"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import saved


def _dealt(df: DataFrame, keys: list, partitions: int | None) -> DataFrame:
    """`df` dealt by range and sorted, saved, with the range (__p) and the row's place in it (__l, from 0).

    Saved as range bounds are drawn anew whenever they are computed, and all readers must see the same ones."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__i", F.monotonically_increasing_id()))
    return rows.select(*df.columns, F.shiftright("__i", 33).alias("__p"), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)).alias("__l"))


def numbered(df: DataFrame, key: str | list[str], partitions: int | None = None, name: str = "rn") -> DataFrame:
    """`df` with 1-based numbers in key order (ties in no fixed order).

    Rows are dealt by range and sorted there; a number is the row's place in its range plus the rows of the ranges before it,
    which are summed over one row per range."""
    dealt = _dealt(df, [key] if isinstance(key, str) else key, partitions)
    size = dealt.groupBy("__p").agg(F.count("*").alias("__c"))
    before = size.select("__p", (F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__b"))
    return dealt.join(F.broadcast(before), "__p").withColumn(name, F.col("__l") + 1 + F.col("__b")).drop("__p", "__l", "__b")


def segmented(df: DataFrame, by: list[str], order: list, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """`df` with 1-based numbers in `order` within each group of `by`, as a window would give, for groups of any size.

    Rows are dealt by range of (by, order), so a large group is many ranges. A number is the row's place in its range less
    that of the group's first row there, plus the group's rows in the ranges before it: sums over a row for each range and group."""
    dealt = _dealt(df, [*by, *order], partitions)
    size = dealt.groupBy("__p", *by).agg(F.count("*").alias("__c"), F.min("__l").alias("__f"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than ranges
    starts = size.select("__p", *by, (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__f") + 1).alias("__b"))
    same = (F.col("d.__p") == F.col("s.__p"))
    for c in by:
        same &= F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    return dealt.alias("d").join(starts.alias("s"), same).select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d.__l") + F.col("s.__b")).alias(name))


def first_rows(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group of `by` in `order`."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "pos") -> DataFrame:
    """The first k rows of each group with their position; Spark prunes to k per group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
