"""One-to-one resolution of retrieval conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import drop_saved, saved


def settle(wishes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., query_id, gallery_id): each query gets the best gallery that no other query with a better claim on it keeps.

    wishes: by..., query_id, gallery_id, place (the smaller, the dearer to the query) and bid (the smaller, the better the
    claim on the gallery). In each round every query asks for its dearest gallery left, and wishes that lose against the
    best asker of their gallery go; a gallery's best asker only ever improves, so they would lose later as well. When
    no wish goes, all askers keep what they ask for. Rounds work on all chains of displacement at once."""
    by = by or []
    left = saved(wishes.select(*by, "query_id", "gallery_id", "place", "bid"))
    n = left.count()
    while True:
        asked = left.groupBy(*by, "query_id").agg(F.min(F.struct("place", "gallery_id", "bid")).alias("x")).select(*by, "query_id", "x.gallery_id", "x.bid")
        held = asked.groupBy(*by, "gallery_id").agg(F.min("bid").alias("best"))
        after = saved(left.join(held, [*by, "gallery_id"], "left").where(F.col("best").isNull() | (F.col("bid") <= F.col("best"))).select(*left.columns))
        m = after.count()
        if m == n:
            out = saved(asked.select(*by, "query_id", "gallery_id"))
            drop_saved(left, after)
            return out
        drop_saved(left)
        left, n = after, m


def stable_match(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., query_id, gallery_id): the stable matching of candidate edges (query_id, gallery_id, score).

    Both sides rank a pair by its score; ties go to the smaller query, then gallery id. Unmatched queries are left out."""
    return settle(edges.withColumn("place", F.struct(-F.col("score"), F.col("gallery_id"))).withColumn("bid", F.struct(-F.col("score"), F.col("query_id"))), by)


def promote(order: DataFrame, match: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`order` with each query's match moved to position 1 and the ones before it moved down; others stay as they are."""
    by = by or []
    keys = [*by, "query_id"]
    m = match.select(*keys, F.col("gallery_id").alias("__m"))
    at = order.join(m, keys, "left")
    w = Window.partitionBy(*keys)
    at = at.withColumn("__p", F.max(F.when(F.col("gallery_id") == F.col("__m"), F.col("pos"))).over(w))
    new = F.when(F.col("gallery_id") == F.col("__m"), F.lit(1)).when(F.col("pos") < F.col("__p"), F.col("pos") + 1).otherwise(F.col("pos"))
    return at.withColumn("pos", new).drop("__m", "__p")


def greedy_resolve(order: DataFrame) -> DataFrame:
    """Conflict groups in the order of their first query: the best first score keeps the gallery, each loser takes its first
    candidate that nobody holds, or keeps its own.

    A gallery that is somebody's first choice always keeps a holder, so losers choose among the others, each with a better
    claim than all losers after it; see settle()."""
    top = order.where("pos = 1").select("query_id", F.col("gallery_id").alias("top"), "score")
    groups = top.groupBy("top").agg(F.count("*").alias("claims"), F.min("query_id").alias("first"), F.min(F.struct(-F.col("score"), F.col("query_id").alias("q"))).alias("keep"))
    losers = top.join(groups.where("claims > 1"), "top").where(F.col("query_id") != F.col("keep.q")).select("query_id", F.struct("first", "query_id").alias("bid"))
    wishes = order.join(losers, "query_id").join(groups.select(F.col("top").alias("gallery_id")), "gallery_id", "left_anti")
    moved = settle(wishes.select("query_id", "gallery_id", F.col("pos").alias("place"), "bid"))
    return promote(order, moved)


def resolve(order: DataFrame, method: str) -> DataFrame:
    """`order` after none, greedy or stable resolution."""
    if method == "none":
        return order
    if method == "greedy":
        return greedy_resolve(order)
    if method == "stable":
        return promote(order, stable_match(order))
    raise ValueError(f"unknown method {method}")
