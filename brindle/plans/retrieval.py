"""Retrieval queries: similarity, ranks, candidates, fusion, conflict resolution, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import clamp, dot, l2_normalize, norm, temperature
from ..operators import assignment, blocks, experiment, ranking
from ..operators.components import drop_saved, saved
from ..operators.ordering import first_rows
from ..sources import fixtures

K = 10
ALPHAS = (0.0, 0.5, 1.0, 2.0, 4.0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, gallery_id, score, gt_score, labels of both sides."""
    g = fixtures.gallery(spark, sf_dir)
    q = ranking.with_truth(fixtures.retrieval_queries(spark, sf_dir), g).withColumnRenamed("label", "q_label")
    return ranking.scores(q, g)


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries with gt_score, and the gallery."""
    g = fixtures.gallery(spark, sf_dir)
    return ranking.with_truth(fixtures.retrieval_queries(spark, sf_dir), g), g


def _hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """One pass over all pairs: the k best, the target's rank and statistics, by query and block."""
    return blocks.scan(*_asked(spark, sf_dir), k)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-K candidates."""
    return blocks.candidates(_hits(spark, sf_dir), K)


def _first_stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Saved top-K candidates, and query_id, gt_id, first_rank, above: both from one pass over the pairs."""
    q, g = _asked(spark, sf_dir)
    q = saved(q)
    hits = blocks.scan(q, g, K)
    cand = saved(blocks.candidates(hits, K).join(q.select("query_id", "gt_score"), "query_id"))
    above = cand.groupBy("query_id").agg(F.sum((F.col("score") >= F.col("gt_score")).cast("long")).alias("above"))
    rank = blocks.ranks(hits).select("query_id", F.col("rank").alias("first_rank"), "largest")
    truth = saved(q.select("query_id", "gt_id").join(rank, "query_id").join(above, "query_id", "left").withColumn("above", F.coalesce("above", F.lit(0))))
    drop_saved(q, hits)
    return cand.drop("gt_score"), truth


def _second_stage(spark: SparkSession, sf_dir: str, cand: DataFrame | None = None) -> DataFrame:
    """Top-K candidates with first-stage score, min-max of it, and the pair score of the first 32 dimensions."""
    cand = cand or _candidates(spark, sf_dir)
    q = fixtures.retrieval_queries(spark, sf_dir).select("query_id", F.col("vec").alias("qv"))
    g = fixtures.gallery(spark, sf_dir).select("gallery_id", F.col("vec").alias("gv"))
    pair = cand.join(q, "query_id").join(g, "gallery_id").withColumn("pair_score", dot(F.col("qv"), F.col("gv"), 32)).drop("qv", "gv")
    return pair.withColumn("first_norm", ranking.minmax(F.col("score"), ["query_id"]))


def _fused(spark: SparkSession, sf_dir: str, cand: DataFrame | None = None, alpha: float = 2.0) -> DataFrame:
    """query_id, gallery_id, score (fused), pos."""
    f = _second_stage(spark, sf_dir, cand).withColumn("score", F.col("pair_score") + F.lit(alpha) * F.col("first_norm"))
    return ranking.rerank(f.select("query_id", "gallery_id", "score"), ["query_id"], "score")


def retrieval_report(spark, sf_dir):
    return ranking.report(blocks.ranks(_hits(spark, sf_dir, 0)))


def rank_of_gt(spark, sf_dir):
    return blocks.ranks(_hits(spark, sf_dir, 0)).select("query_id", "rank")


def recall_at_k(spark, sf_dir):
    r = blocks.ranks(_hits(spark, sf_dir, 0))
    k = F.explode(F.array(*[F.lit(x) for x in (1, 5, 10, 50)])).alias("k")
    return r.select("rank", k).groupBy("k").agg(F.round(F.avg((F.col("rank") <= F.col("k")).cast("double")), 6).alias("recall"))


def rank_ties(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("score", F.round("score", 1)).withColumn("gt_score", F.round("gt_score", 1))
    return ranking.rank_of_truth(s)


def map_multi(spark, sf_dir):
    ap = blocks.average_precision(fixtures.retrieval_queries(spark, sf_dir), fixtures.gallery(spark, sf_dir))
    return ap.agg(F.round(F.coalesce(F.avg("ap"), F.lit(0.0)), 6).alias("map_multi"), F.count("*").alias("queries"))


def gallery_dedupe(spark, sf_dir):
    g = fixtures.gallery(spark, sf_dir).select("gallery_id", "label")
    twice = g.withColumn("row", F.col("gallery_id")).unionByName(g.select("gallery_id", (F.col("label") + 100).alias("label"), (F.col("gallery_id") + 1_000_000).alias("row")))
    return first_rows(twice, ["gallery_id"], ["row"])


def candidate_topk(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query_id", "pos", "gallery_id", F.round("score", 6).alias("score"))


def minmax_fuse_rank(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "gallery_id", "pos", F.round("score", 6).alias("score"))


def _candidate_report(order: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Report of a candidate order with coverage, second places and conflicts."""
    by = by or []
    r = ranking.rank_after_rerank(order, truth, K, by)
    recall = [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"r{k}") for k in (1, 5, 10, 50, 200)]
    rep = r.groupBy(*by).agg(
        F.round(F.avg(1 / F.col("rank")), 6).alias("map"), *recall, F.round(F.avg((F.col("rank") <= K).cast("double")), 6).alias("coverage"), F.sum((F.col("rank") == 2).cast("long")).alias("rank2")
    )
    conf = ranking.top1_conflicts(order, by).select(*by, "conflicts")
    return rep.join(conf, by) if by else rep.crossJoin(conf)


def candidate_report(spark, sf_dir):
    cand, truth = _first_stage(spark, sf_dir)
    return _candidate_report(_fused(spark, sf_dir, cand), truth)


def top1_conflicts(spark, sf_dir):
    return ranking.top1_conflicts(blocks.candidates(_hits(spark, sf_dir, 1), 1)).select("queries", "distinct_top1", "conflicts")


def _first_order(spark, sf_dir):
    return _candidates(spark, sf_dir)


def stable_matching(spark, sf_dir):
    return assignment.stable_match(_first_order(spark, sf_dir)).select("query_id", "gallery_id")


def promoted_order(spark, sf_dir):
    return assignment.resolve(_first_order(spark, sf_dir), "stable").select("query_id", "gallery_id", "pos")


def greedy_resolve(spark, sf_dir):
    return assignment.resolve(_first_order(spark, sf_dir), "greedy").select("query_id", "gallery_id", "pos")


def postprocess_none(spark, sf_dir):
    return assignment.resolve(_first_order(spark, sf_dir), "none").select("query_id", "gallery_id", "pos")


def two_stage_report(spark, sf_dir):
    """Candidates, fusion, stable matching, promotion and the final report."""
    cand, truth = _first_stage(spark, sf_dir)
    return _candidate_report(assignment.resolve(saved(_fused(spark, sf_dir, cand)), "stable"), truth)


def _sweep(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Report of every alpha and method, and the truth of the first stage."""
    cand, truth = _first_stage(spark, sf_dir)
    base = _second_stage(spark, sf_dir, cand).select("query_id", "gallery_id", "pair_score", "first_norm")
    alphas = F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha")
    swept = base.select("*", alphas).withColumn("score", F.col("pair_score") + F.col("alpha") * F.col("first_norm"))
    order = ranking.rerank(swept.select("alpha", "query_id", "gallery_id", "score"), ["alpha", "query_id"], "score")
    stable = assignment.promote(order, assignment.stable_match(order, ["alpha"]), ["alpha"])
    both = order.withColumn("method", F.lit("none")).unionByName(stable.withColumn("method", F.lit("stable")))
    return _candidate_report(both, truth, ["alpha", "method"]), truth


def alpha_sweep_select(spark, sf_dir):
    sweep, truth = _sweep(spark, sf_dir)
    baseline = ranking.report(truth.select(F.col("first_rank").alias("rank"))).select(F.col("r10").alias("floor"))
    return experiment.select_best(sweep.crossJoin(baseline)).select("alpha", "method", "map", "r1", "r5", "r10", "conflicts")


def similarity_pairs(spark, sf_dir):
    r = blocks.ranks(_hits(spark, sf_dir, 0))
    return r.select("query_id", "n", F.round("largest", 6).alias("largest"), F.round("smallest", 6).alias("smallest"), F.round(F.col("total") / F.col("n"), 5).alias("mean"))


def l2_norm(spark, sf_dir):
    q = fixtures.retrieval_queries(spark, sf_dir)
    return q.select("query_id", F.round(norm(F.col("vec")), 6).alias("length"), F.round(norm(l2_normalize(F.col("vec"))), 6).alias("unit"))


def temperature_clamp(spark, sf_dir):
    """Temperatures of scales that the vectors' first components spread over -20 to 20."""
    x = fixtures.gallery(spark, sf_dir).select("gallery_id", (F.get("vec", F.lit(0)).cast("double") * 20).alias("logit_scale"))
    return x.select("gallery_id", F.round(temperature(F.col("logit_scale")), 6).alias("temperature"), F.round(clamp(F.col("logit_scale"), 0.001, 0.5), 6).alias("clamped"))


def metric_log(spark, sf_dir) -> DataFrame:
    """(run, step, map, r1, r10): retrieval metrics of each 10 queries, ten evaluations a run."""
    r = blocks.ranks(_hits(spark, sf_dir, 0)).withColumn("at", F.floor(F.col("query_id") / 50))
    mean = lambda c: F.round(F.avg(c), 6)
    return r.groupBy(F.floor(F.col("at") / 10).alias("run"), (F.col("at") % 10).alias("step")).agg(mean(1 / F.col("rank")).alias("map"), mean((F.col("rank") <= 1).cast("double")).alias("r1"), mean((F.col("rank") <= 10).cast("double")).alias("r10"))


def label_report(spark, sf_dir) -> DataFrame:
    """(name, split, map, r1, r5): retrieval metrics of the queries of each label; some labels are of another split than report."""
    q = fixtures.retrieval_queries(spark, sf_dir).select("query_id", "label")
    r = blocks.ranks(_hits(spark, sf_dir, 0)).join(q, "query_id")
    out = r.groupBy("label").agg(F.avg(1 / F.col("rank")).alias("map"), F.avg((F.col("rank") <= 1).cast("double")).alias("r1"), F.avg((F.col("rank") <= 5).cast("double")).alias("r5"))
    return out.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), F.when(F.col("label") % 3 == 0, "dev").otherwise("report").alias("split"), "map", "r1", "r5")


def rank_band_scores(spark, sf_dir):
    """Ranks and top scores when the listed candidates stand in a band above all other scores.

    The band begins at the query's largest score; position 1 is K / (K + 1) above it. Ranks follow by counting."""
    cand, truth = _first_stage(spark, sf_dir)
    order = _fused(spark, sf_dir, cand).select("query_id", "gallery_id", "pos")
    r = ranking.rank_after_rerank(order, truth, K)
    return r.select("query_id", "rank", F.round(F.col("largest") + K / F.lit(K + 1.0), 6).alias("top"))


def candidate_gather(spark, sf_dir):
    return _second_stage(spark, sf_dir).select("query_id", "gallery_id", F.round("pair_score", 6).alias("pair_score"), F.round("first_norm", 6).alias("first_norm"))


QUERIES = [
    retrieval_report, rank_of_gt, recall_at_k, rank_ties, map_multi, gallery_dedupe, candidate_topk, minmax_fuse_rank, candidate_report, top1_conflicts,
    stable_matching, promoted_order, greedy_resolve, postprocess_none, two_stage_report, alpha_sweep_select, similarity_pairs, l2_norm, temperature_clamp,
    rank_band_scores, candidate_gather,
]

FXE = """
WITH RECURSIVE nn AS (SELECT count(*) AS n FROM embeddings),
qs AS (SELECT a.vec_id AS query_id, a.label AS q_label,
  list_transform(range(1, 65), lambda i: CAST((CAST(a.embedding[i] AS DOUBLE) + a.w * CAST(b.embedding[i] AS DOUBLE)) + (CAST(0.8 AS DOUBLE) * a.w) * CAST(c.embedding[i] AS DOUBLE) AS FLOAT)) AS f
  FROM (SELECT *, CAST(([0.6, 1.2, 1.8, 2.4])[(vec_id // 5) % 4 + 1] AS DOUBLE) AS w FROM embeddings WHERE vec_id % 5 = 0) a
  CROSS JOIN nn JOIN embeddings b ON b.vec_id = (a.vec_id // 25) * 25 + 1 JOIN embeddings c ON c.vec_id = (37 * a.vec_id + 11) % nn.n),
s AS (SELECT query_id, q_label, vec_id AS gallery_id, label, list_dot_product(CAST(f AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM qs CROSS JOIN embeddings),
gt AS (SELECT query_id, score AS gt_score FROM s WHERE query_id = gallery_id),
rk AS (SELECT query_id, count(*) AS rank FROM s JOIN gt USING (query_id) WHERE score >= gt_score GROUP BY 1),
c AS (SELECT * FROM (SELECT query_id, gallery_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gallery_id) AS pos FROM s) WHERE pos <= 10)
"""
FUSED = """,
p AS (SELECT c.*, list_dot_product(CAST(f[1:32] AS DOUBLE[]), CAST(embedding[1:32] AS DOUBLE[])) AS pair_score,
  (score - min(score) OVER (PARTITION BY query_id)) / greatest(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id), 1e-8) AS first_norm
  FROM c JOIN qs USING (query_id) JOIN embeddings ON vec_id = gallery_id),
f AS (SELECT query_id, gallery_id, fused AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, gallery_id) AS pos
  FROM (SELECT *, pair_score + CAST(2.0 AS DOUBLE) * first_norm AS fused FROM p)),
tr AS (SELECT rk.query_id, rank AS first_rank, (SELECT count(*) FROM c JOIN gt USING (query_id) WHERE c.query_id = rk.query_id AND score >= gt_score) AS above FROM rk)
"""


def _matching(edges: str) -> str:
    """Greedy walk over all edges by descending score: the stable matching for shared scores."""
    return f""",
el AS (SELECT query_id, gallery_id, row_number() OVER (ORDER BY score DESC, query_id, gallery_id) AS i FROM {edges}),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS uq, CAST([] AS BIGINT[]) AS ug
  UNION ALL SELECT el.i, CASE WHEN ok THEN list_append(uq, query_id) ELSE uq END, CASE WHEN ok THEN list_append(ug, gallery_id) ELSE ug END
  FROM (SELECT walk.i AS at, uq, ug, el.*, NOT list_contains(uq, query_id) AND NOT list_contains(ug, gallery_id) AS ok FROM walk JOIN el ON el.i = walk.i + 1) el),
fin AS (SELECT uq, ug FROM walk ORDER BY i DESC LIMIT 1),
m AS (SELECT unnest(uq) AS query_id, unnest(ug) AS gallery_id FROM fin)
"""


_GREEDY = """,
tp AS (SELECT query_id, gallery_id, score, row_number() OVER (PARTITION BY gallery_id ORDER BY score DESC, query_id) AS place, min(query_id) OVER (PARTITION BY gallery_id) AS first FROM c WHERE pos = 1),
lo AS (SELECT query_id, wish, row_number() OVER (ORDER BY first, query_id) AS i FROM tp JOIN (SELECT query_id, list(gallery_id ORDER BY pos) AS wish FROM c GROUP BY 1) USING (query_id) WHERE place > 1),
walk AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(DISTINCT gallery_id) FROM tp) AS used, CAST([] AS BIGINT[]) AS uq, CAST([] AS BIGINT[]) AS ug
  UNION ALL SELECT i, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, CASE WHEN got IS NULL THEN uq ELSE list_append(uq, query_id) END, CASE WHEN got IS NULL THEN ug ELSE list_append(ug, got) END
  FROM (SELECT lo.i, used, uq, ug, query_id, list_filter(wish, lambda x: NOT list_contains(used, x))[1] AS got FROM walk JOIN lo ON lo.i = walk.i + 1) x),
fin AS (SELECT uq, ug FROM walk ORDER BY i DESC LIMIT 1),
m AS (SELECT unnest(uq) AS query_id, unnest(ug) AS gallery_id FROM fin)
"""


def _promoted(order: str) -> str:
    return f""",
pr AS (SELECT o.query_id, o.gallery_id, o.score, CASE WHEN o.gallery_id = m.gallery_id THEN 1 WHEN o.pos < mp.pos THEN o.pos + 1 ELSE o.pos END AS pos
  FROM {order} o LEFT JOIN m ON m.query_id = o.query_id LEFT JOIN {order} mp ON mp.query_id = o.query_id AND mp.gallery_id = m.gallery_id)
"""


def _report(order: str) -> str:
    return f""",
fr AS (SELECT tr.query_id, coalesce(o.pos, 10 + first_rank - above) AS rank FROM tr LEFT JOIN {order} o ON o.query_id = tr.query_id AND o.gallery_id = tr.query_id)
SELECT round(avg(1.0 / rank), 6) AS map, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 5)::INT), 6) AS r5, round(avg((rank <= 10)::INT), 6) AS r10, round(avg((rank <= 50)::INT), 6) AS r50, round(avg((rank <= 200)::INT), 6) AS r200,
  round(avg((rank <= 10)::INT), 6) AS coverage, sum((rank = 2)::INT)::BIGINT AS rank2, (SELECT count(*) - count(DISTINCT gallery_id) FROM {order} WHERE pos = 1) AS conflicts FROM fr
"""


_SWEEP = (
    FXE
    + FUSED
    + """,
al AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS alpha),
sw AS (SELECT alpha, query_id, gallery_id, score, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, gallery_id) AS pos FROM (SELECT alpha, query_id, gallery_id, pair_score + alpha * first_norm AS score FROM p, al)),
el AS (SELECT alpha, query_id, gallery_id, row_number() OVER (PARTITION BY alpha ORDER BY score DESC, query_id, gallery_id) AS i FROM sw),
walk AS (SELECT alpha, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS uq, CAST([] AS BIGINT[]) AS ug FROM al
  UNION ALL SELECT alpha, x.i, CASE WHEN ok THEN list_append(uq, query_id) ELSE uq END, CASE WHEN ok THEN list_append(ug, gallery_id) ELSE ug END
  FROM (SELECT el.alpha, el.i, uq, ug, query_id, gallery_id, NOT list_contains(uq, query_id) AND NOT list_contains(ug, gallery_id) AS ok FROM walk JOIN el ON el.alpha = walk.alpha AND el.i = walk.i + 1) x),
fin AS (SELECT alpha, max_by(uq, i) AS uq, max_by(ug, i) AS ug FROM walk GROUP BY alpha),
m AS (SELECT alpha, unnest(uq) AS query_id, unnest(ug) AS gallery_id FROM fin),
pr AS (SELECT o.alpha, o.query_id, o.gallery_id, CASE WHEN o.gallery_id = m.gallery_id THEN 1 WHEN o.pos < mp.pos THEN o.pos + 1 ELSE o.pos END AS pos
  FROM sw o LEFT JOIN m ON m.alpha = o.alpha AND m.query_id = o.query_id LEFT JOIN sw mp ON mp.alpha = o.alpha AND mp.query_id = o.query_id AND mp.gallery_id = m.gallery_id),
bo AS (SELECT alpha, 'none' AS method, query_id, gallery_id, pos FROM sw UNION ALL SELECT alpha, 'stable', query_id, gallery_id, pos FROM pr),
fr AS (SELECT am.alpha, am.method, coalesce(o.pos, 10 + first_rank - above) AS rank FROM tr CROSS JOIN (SELECT DISTINCT alpha, method FROM bo) am
  LEFT JOIN bo o ON o.alpha = am.alpha AND o.method = am.method AND o.query_id = tr.query_id AND o.gallery_id = tr.query_id),
v AS (SELECT alpha, method, round(avg(1.0 / rank), 6) AS map, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 5)::INT), 6) AS r5, round(avg((rank <= 10)::INT), 6) AS r10 FROM fr GROUP BY ALL),
cf AS (SELECT alpha, method, count(*) - count(DISTINCT gallery_id) AS conflicts FROM bo WHERE pos = 1 GROUP BY ALL),
fl AS (SELECT round(avg((rank <= 10)::INT), 6) AS base FROM rk)
SELECT alpha, method, map, r1, r5, r10, conflicts FROM v JOIN cf USING (alpha, method) CROSS JOIN fl
ORDER BY (r10 >= base - 1e-9) DESC, map DESC, r1 DESC, r5 DESC, conflicts, alpha, method LIMIT 1
"""
)

SQL = {
    "retrieval_report": FXE + "SELECT round(avg(1.0 / rank), 6) AS map, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 5)::INT), 6) AS r5, round(avg((rank <= 10)::INT), 6) AS r10 FROM rk",
    "rank_of_gt": FXE + "SELECT query_id, rank FROM rk",
    "recall_at_k": FXE + "SELECT k, round(avg((rank <= k)::INT), 6) AS recall FROM rk, (SELECT unnest([1, 5, 10, 50]) AS k) GROUP BY k",
    "rank_ties": FXE + "SELECT query_id, count(*) AS rank FROM s JOIN gt USING (query_id) WHERE round(score, 1) >= round(gt_score, 1) GROUP BY 1",
    "map_multi": FXE
    + """, r AS (SELECT query_id, (label = q_label)::INT AS rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gallery_id) AS rank FROM s),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r),
ap AS (SELECT query_id, sum(hits / rank) / count(*) AS ap FROM h WHERE rel = 1 GROUP BY 1)
SELECT round(coalesce(avg(ap), 0), 6) AS map_multi, count(*) AS queries FROM ap""",
    "gallery_dedupe": "SELECT vec_id AS gallery_id, label, vec_id AS row FROM embeddings",
    "candidate_topk": FXE + "SELECT query_id, pos::INT AS pos, gallery_id, round(score, 6) AS score FROM c",
    "minmax_fuse_rank": FXE + FUSED + "SELECT query_id, gallery_id, pos::INT AS pos, round(score, 6) AS score FROM f",
    "candidate_report": FXE + FUSED + _report("f"),
    "top1_conflicts": FXE + "SELECT count(*) AS queries, count(DISTINCT gallery_id) AS distinct_top1, count(*) - count(DISTINCT gallery_id) AS conflicts FROM c WHERE pos = 1",
    "stable_matching": FXE + _matching("c") + "SELECT query_id, gallery_id FROM m",
    "promoted_order": FXE + _matching("c") + _promoted("c") + "SELECT query_id, gallery_id, pos::INT AS pos FROM pr",
    "greedy_resolve": FXE + _GREEDY + _promoted("c") + "SELECT query_id, gallery_id, pos::INT AS pos FROM pr",
    "postprocess_none": FXE + "SELECT query_id, gallery_id, pos::INT AS pos FROM c",
    "two_stage_report": FXE + FUSED + _matching("f") + _promoted("f") + _report("pr"),
    "alpha_sweep_select": _SWEEP,
    "similarity_pairs": FXE + "SELECT query_id, count(*) AS n, round(max(score), 6) AS largest, round(min(score), 6) AS smallest, round(avg(score), 5) AS mean FROM s GROUP BY 1",
    "l2_norm": FXE + ", l AS (SELECT query_id, f, sqrt(list_dot_product(CAST(f AS DOUBLE[]), CAST(f AS DOUBLE[]))) AS n FROM qs) SELECT query_id, round(n, 6) AS length, CAST(1.0 AS DOUBLE) AS unit FROM l",
    "temperature_clamp": "SELECT vec_id AS gallery_id, round(least(greatest(exp(-x), 1e-3), 0.5), 6) AS temperature, round(least(greatest(x, 0.001), 0.5), 6) AS clamped FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 20 AS x FROM embeddings)",
    "rank_band_scores": FXE
    + FUSED
    + """, b AS (SELECT s.query_id, s.gallery_id, CASE WHEN f.pos IS NOT NULL THEN max(s.score) OVER (PARTITION BY s.query_id) + (10 - f.pos + 1) / CAST(11.0 AS DOUBLE) ELSE s.score END AS band FROM s LEFT JOIN f USING (query_id, gallery_id)),
g2 AS (SELECT query_id, band AS gb FROM b WHERE query_id = gallery_id)
SELECT query_id, count(*) FILTER (band >= gb) AS rank, round(max(band), 6) AS top FROM b JOIN g2 USING (query_id) GROUP BY 1""",
    "candidate_gather": FXE + FUSED + "SELECT query_id, gallery_id, round(pair_score, 6) AS pair_score, round(first_norm, 6) AS first_norm FROM p",
}
