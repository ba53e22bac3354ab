"""Query against gallery: exact scores, candidates, fusion, and rank metrics.

Scores live in long form. A comparison of all pairs is done in blocks: gallery rows are dealt to blocks and queries
copied to each block, so that no row of scores is shuffled before it is counted or pruned to the best k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot

#: Most queries that are copied to every task by broadcast; more are copied block by block through a shuffle.
BROADCAST_QUERIES = 20_000


def scores(queries: DataFrame, gallery: DataFrame, dim: int = 64, blocks: int | None = None) -> DataFrame:
    """(query_id, gallery_id, score) of all pairs, with the queries' and gallery's columns other than vec.

    A gallery in fewer partitions than there are cores is dealt out first, so that all cores score."""
    q = queries.withColumnRenamed("vec", "qv")
    g = gallery.withColumnRenamed("vec", "gv")
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        if g.rdd.getNumPartitions() < cores:
            g = g.repartition(cores, "gallery_id")
        pairs = g.crossJoin(F.broadcast(q))
    else:
        n = blocks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        g = g.withColumn("__b", F.pmod(F.xxhash64("gallery_id"), F.lit(n)))
        q = q.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        pairs = g.join(q, "__b").drop("__b")
    return pairs.withColumn("score", dot(F.col("qv"), F.col("gv"), dim)).drop("qv", "gv")


def with_truth(queries: DataFrame, gallery: DataFrame, dim: int = 64) -> DataFrame:
    """`queries` with gt_score, the score of each query's own target."""
    g = gallery.select(F.col("gallery_id").alias("gt_id"), F.col("vec").alias("gv"))
    return queries.join(g, "gt_id").withColumn("gt_score", dot(F.col("vec"), F.col("gv"), dim)).drop("gv")


def rank_of_truth(scored: DataFrame) -> DataFrame:
    """(query_id, rank): pessimistic rank of the target, 1 + larger ones + equal ones other than itself. Needs gt_score."""
    return scored.groupBy("query_id").agg(F.sum((F.col("score") >= F.col("gt_score")).cast("long")).alias("rank"))


def report(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: mAP (= MRR for one target), and the share of queries with rank <= k."""
    return ranks.agg(
        F.round(F.avg(1 / F.col("rank")), 6).alias("map"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"),
        *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"r{k}") for k in ks],
    )


def candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best gallery rows of each query with pos; ties go to the smaller gallery id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gallery_id")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def minmax(x: Column, by: list[str], eps: float = 1e-8) -> Column:
    """(x - min) / max(max - min, eps) within the group."""
    w = Window.partitionBy(*by)
    return (x - F.min(x).over(w)) / F.greatest(F.max(x).over(w) - F.min(x).over(w), F.lit(eps))


def rerank(cand: DataFrame, by: list[str], score: str, pos: str = "pos") -> DataFrame:
    """`cand` with new positions by `score`; ties go to the smaller gallery id."""
    return cand.withColumn(pos, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "gallery_id")))


def rank_after_rerank(order: DataFrame, truth: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Rank of each target when the k listed candidates stand above all others.

    order: by..., query_id, gallery_id, pos. truth: query_id, gt_id, first_rank, above: the target's first-stage rank and
    the candidates of the first stage that scored at least as much. A listed target has its position. An unlisted one
    comes after the k listed ones and the others that scored at least as much, itself included."""
    by = by or []
    got = order.join(truth.select("query_id", "gt_id"), "query_id").where("gallery_id = gt_id").select(*by, "query_id", "pos")
    keys = [*by, "query_id"]
    base = order.select(*keys).distinct().join(truth, "query_id")
    return base.join(got, keys, "left").withColumn("rank", F.coalesce(F.col("pos").cast("long"), k + F.col("first_rank") - F.col("above"))).drop("pos")


def average_precision(ranked: DataFrame) -> DataFrame:
    """(query_id, ap) from query_id, rank, relevant (0/1); queries without a relevant row are left out."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = ranked.withColumn("hits", F.sum("relevant").over(w))
    return hit.where("relevant = 1").groupBy("query_id").agg((F.sum(F.col("hits") / F.col("rank")) / F.count("*")).alias("ap"))


def top1_conflicts(order: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Queries minus distinct galleries at position 1."""
    return order.where("pos = 1").groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.count_distinct("gallery_id").alias("distinct_top1")).withColumn("conflicts", F.col("queries") - F.col("distinct_top1"))
