"""Training queries: losses, memory, schedules and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from ..operators import batching, experiment, losses
from ..operators.guards import assert_report
from ..sources import fixtures, tables
from . import retrieval

TEMPERATURE, TAU, CAPACITY = 0.07, 0.01, 128

#: Least r10 of an evaluation that is accepted, and rejected ones in a row that stop a run.
FLOOR, PATIENCE = 0.7, 3


def _rows(spark, sf_dir):
    return fixtures.sequence(spark, sf_dir)


def _pairs(spark, sf_dir):
    return losses.in_batch_pairs(_rows(spark, sf_dir)).withColumn("own", F.col("i") == F.col("j"))


def itc_loss(spark, sf_dir):
    return losses.itc_of_batches(_rows(spark, sf_dir), TEMPERATURE).select("batch", F.round("loss", 6).alias("loss"))


def smooth_ap(spark, sf_dir):
    return losses.smooth_ap_of_batches(_rows(spark, sf_dir), TAU).select("batch", F.round("loss", 6).alias("loss"))


def itm_ce(spark, sf_dir):
    r = _rows(spark, sf_dir)
    s1, s0 = dot(F.col("img"), F.col("txt"), 64), dot(F.col("img"), F.col("txt"), 32)
    return r.select("batch", losses.two_way_ce(s0, s1, (F.col("instance") % 2).cast("int")).alias("ce")).groupBy("batch").agg(F.round(F.avg("ce"), 6).alias("loss"))


def _memory(spark, sf_dir):
    return losses.memory_pairs(_rows(spark, sf_dir).withColumnRenamed("event_id", "seq"), CAPACITY)


def masked_pairs(spark, sf_dir):
    return losses.masked(_pairs(spark, sf_dir)).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col("masked").cast("long")).alias("masked"))


def memory_loss(spark, sf_dir):
    rows, vectors = fixtures.sequence_keys(spark, sf_dir)
    loss = losses.memory_loss_of_batches(rows.withColumnRenamed("event_id", "seq"), CAPACITY, TEMPERATURE, vectors=vectors)
    return loss.select("batch", F.round("loss", 6).alias("loss"))


def memory_window(spark, sf_dir):
    return _memory(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("pairs"), F.count_distinct("j").alias("slots"), F.max("age").alias("oldest"), F.min("age").alias("newest"))


def memory_diagnostics(spark, sf_dir):
    rows, vectors = fixtures.sequence_keys(spark, sf_dir)
    m = losses.memory_diagnostics_of_batches(rows.withColumnRenamed("event_id", "seq"), CAPACITY, vectors=vectors)
    return m.select("batch", "size", F.round(F.col("size") / CAPACITY, 6).alias("fill"), F.round("age", 6).alias("age"), F.round("hardest", 6).alias("hardest"))


def memory_state(spark, sf_dir):
    """What the memory holds when each batch starts: rows and clock, counted from the epoch's beginning."""
    b = _rows(spark, sf_dir).groupBy("epoch", "batch").agg(F.count("*").alias("n"))
    w = Window.partitionBy("epoch").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("epoch", "batch", F.least(F.coalesce(F.sum("n").over(w), F.lit(0)), F.lit(CAPACITY)).alias("filled"), F.coalesce(F.count("*").over(w), F.lit(0)).alias("clock"))


def similarity_diagnostics(spark, sf_dir):
    """Mean similarity of own, partner and rolled pairs."""
    p = _pairs(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("batch", "i"))
    roll = F.pmod(F.col("i") - 1, F.col("n"))
    p = p.withColumn("n", n)
    mean = lambda cond: F.round(F.avg(F.when(cond, F.col("sim"))), 6)
    right = F.avg((F.col("sim") > 0).cast("double"))
    return p.groupBy("batch").agg(mean(F.col("own")).alias("positive"), mean(F.col("j") == F.col("i").bitwiseXOR(F.lit(1).cast("long"))).alias("paired"), mean(F.col("j") == roll).alias("random"), F.round(right, 6).alias("above_zero"))


def itm_pairs_sampled(spark, sf_dir):
    p = losses.masked(_pairs(spark, sf_dir)).withColumn("forbidden", F.col("masked") | F.col("own"))
    return batching.sampled_negatives(p, ["batch"], TEMPERATURE)


def _losses(spark, sf_dir):
    """(epoch, step, a, b, c): three loss values of each batch, means of a third of its events' values each."""
    e = tables.table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    third = lambda k: (1 + F.sum(F.when(F.col("event_id") % 3 == k, F.col("cents")).otherwise(0)) / 1000.0)
    return e.groupBy(F.floor(F.col("event_id") / 2560).alias("epoch"), F.floor(F.col("event_id") / 32).alias("step")).agg(*[third(k).alias(n) for k, n in enumerate("abc")])


def loss_weights_dwa(spark, sf_dir):
    w = experiment.dynamic_weights(_losses(spark, sf_dir), ["a", "b", "c"], "step", by="epoch")
    return w.select("epoch", "step", *[F.round(f"w_{n}", 6).alias(f"w_{n}") for n in "abc"])


def weighted_losses(spark, sf_dir):
    """Fixed weights, and uncertainty weights exp(-s) w L + s."""
    rows = _losses(spark, sf_dir)
    s1, s2 = (F.col("step") % 10) / 10.0, -((F.col("step") % 10) / 5.0)
    return rows.select("step", F.round(F.col("a") + 0.5 * F.col("b"), 6).alias("fixed"), F.round(F.exp(-s1) * F.col("a") + s1 + F.exp(-s2) * 0.5 * F.col("b") + s2, 6).alias("uncertainty"))


def lr_schedule(spark, sf_dir):
    """Factor of each batch of the events' training run."""
    steps = tables.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 32).alias("step")).distinct()
    last = steps.agg(F.max("step").alias("last"))
    return steps.crossJoin(F.broadcast(last)).select("step", F.round(experiment.lr_schedule(F.col("step"), 5, F.col("last")), 6).alias("factor"))  # one row


def early_stop(spark, sf_dir):
    return experiment.early_stop(retrieval.metric_log(spark, sf_dir), PATIENCE, FLOOR, ["run"])


def checkpoint_select(spark, sf_dir):
    """Of each run the best by r10 then r1 (retriever), and the best by map above the floor (reranker)."""
    log = retrieval.metric_log(spark, sf_dir)
    first = lambda *order: F.max_by("step", F.struct(*[F.col(c) for c in order], -F.col("step"))).alias("step")
    a = log.groupBy("run").agg(first("r10", "r1")).select("run", F.lit("retriever").alias("kind"), "step")
    b = log.where(F.col("r10") >= FLOOR).groupBy("run").agg(first("map")).select("run", F.lit("reranker").alias("kind"), "step")
    return a.unionByName(b)


def report_table(spark, sf_dir):
    """The report's table in per cent, of complete metrics of the report split only."""
    rows = retrieval.label_report(spark, sf_dir).where("split = 'report'")
    assert_report(rows, ("map", "r1", "r5"))
    return rows.select("name", *[experiment.percent(F.col(c)).alias(c) for c in ("map", "r1", "r5")])


QUERIES = [
    itc_loss, smooth_ap, itm_ce, memory_loss, memory_window, memory_diagnostics, memory_state, masked_pairs, similarity_diagnostics, itm_pairs_sampled,
    loss_weights_dwa, weighted_losses, lr_schedule, early_stop, checkpoint_select, report_table,
]

SEQ = """
WITH nn AS (SELECT count(*) AS n FROM embeddings),
sq AS (SELECT event_id AS seq, event_id // 32 AS batch, event_id // 2560 AS epoch, event_id % 32 AS pos, user_id AS instance, event_type AS caption, x.embedding AS img, y.embedding AS txt
  FROM events CROSS JOIN nn JOIN embeddings x ON x.vec_id = event_id % n JOIN embeddings y ON y.vec_id = (event_id * 7 + 3) % n),
pp AS (SELECT a.batch, a.pos AS i, b.pos AS j, a.pos = b.pos AS own, a.instance = b.instance AS same, (a.instance = b.instance OR a.caption = b.caption) AND a.pos <> b.pos AS masked,
  list_dot_product(CAST(a.img AS DOUBLE[]), CAST(b.txt AS DOUBLE[])) AS sim FROM sq a JOIN sq b USING (batch))
"""
MEM = """,
bs AS (SELECT batch, epoch, min(seq) AS start FROM sq GROUP BY 1, 2),
mm AS (SELECT a.batch, a.pos AS i, bs.start - b.seq AS j, a.batch - b.batch AS age, a.instance = b.instance OR a.caption = b.caption AS masked, list_dot_product(CAST(a.img AS DOUBLE[]), CAST(b.txt AS DOUBLE[])) AS sim
  FROM sq a JOIN bs ON bs.batch = a.batch JOIN sq b ON b.epoch = a.epoch AND b.seq < bs.start AND b.seq >= bs.start - 128)
"""
_LOSS = """WITH c AS (SELECT event_id // 2560 AS epoch, event_id // 32 AS step, event_id % 3 AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
l AS (SELECT epoch, step, 1 + sum(CASE WHEN k = 0 THEN cents ELSE 0 END) / CAST(1000 AS DOUBLE) AS a, 1 + sum(CASE WHEN k = 1 THEN cents ELSE 0 END) / CAST(1000 AS DOUBLE) AS b, 1 + sum(CASE WHEN k = 2 THEN cents ELSE 0 END) / CAST(1000 AS DOUBLE) AS c FROM c GROUP BY 1, 2)
"""
_LOG = retrieval.FXE + """, lg AS (SELECT query_id // 500 AS run, query_id // 50 % 10 AS step, round(avg(1.0 / rank), 6) AS map, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 10)::INT), 6) AS r10 FROM rk GROUP BY 1, 2)
"""

SQL = {
    "itc_loss": SEQ
    + """, w AS (SELECT *, sim / 0.07::DOUBLE AS x, same::INT / sum(same::INT) OVER (PARTITION BY batch, i) AS wi, same::INT / sum(same::INT) OVER (PARTITION BY batch, j) AS wj FROM pp),
a AS (SELECT batch, i, max(x) + ln(sum(exp(x - m))) - sum(wi * x) AS ce FROM (SELECT *, max(x) OVER (PARTITION BY batch, i) AS m FROM w) GROUP BY 1, 2),
b AS (SELECT batch, j, max(x) + ln(sum(exp(x - m))) - sum(wj * x) AS ce FROM (SELECT *, max(x) OVER (PARTITION BY batch, j) AS m FROM w) GROUP BY 1, 2)
SELECT batch, round((a.l + b.l) / 2, 6) AS loss FROM (SELECT batch, avg(ce) AS l FROM a GROUP BY 1) a JOIN (SELECT batch, avg(ce) AS l FROM b GROUP BY 1) b USING (batch)""",
    "smooth_ap": SEQ
    + """, t AS (SELECT p.batch, p.i, p.j, q.same AS g, 1 / (1 + exp(-greatest(-50, least(50, (q.sim - p.sim) / 0.01::DOUBLE)))) AS s FROM pp p JOIN pp q ON q.batch = p.batch AND q.i = p.i AND q.j <> p.j WHERE p.same),
r AS (SELECT batch, i, j, (1 + sum(CASE WHEN g THEN s ELSE 0 END)) / (1 + sum(s)) AS v FROM t GROUP BY 1, 2, 3), ap AS (SELECT batch, i, avg(v) AS ap FROM r GROUP BY 1, 2)
SELECT batch, round(1 - avg(ap), 6) AS loss FROM ap GROUP BY 1""",
    "itm_ce": SEQ
    + """, l AS (SELECT batch, instance % 2 AS y, list_dot_product(CAST(img AS DOUBLE[]), CAST(txt AS DOUBLE[])) AS s1, list_dot_product(CAST(img[1:32] AS DOUBLE[]), CAST(txt[1:32] AS DOUBLE[])) AS s0 FROM sq)
SELECT batch, round(avg(greatest(s0, s1) + ln(exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) - CASE WHEN y = 1 THEN s1 ELSE s0 END), 6) AS loss FROM l GROUP BY 1""",
    "memory_loss": SEQ
    + MEM
    + """, al AS (SELECT batch, i, own, CASE WHEN masked THEN -1e4 ELSE sim / 0.07::DOUBLE END AS x FROM pp UNION ALL SELECT batch, i, false, CASE WHEN masked THEN -1e4 ELSE sim / 0.07::DOUBLE END FROM mm),
ce AS (SELECT batch, i, max(x) + ln(sum(exp(x - m))) - sum(CASE WHEN own THEN x ELSE 0 END) AS ce FROM (SELECT *, max(x) OVER (PARTITION BY batch, i) AS m FROM al) GROUP BY 1, 2)
SELECT batch, round(avg(ce), 6) AS loss FROM ce GROUP BY 1""",
    "memory_window": SEQ + MEM + "SELECT batch, count(*) AS pairs, count(DISTINCT j) AS slots, max(age) AS oldest, min(age) AS newest FROM mm GROUP BY 1",
    "memory_diagnostics": SEQ
    + MEM
    + """, per AS (SELECT batch, i, max(sim) FILTER (NOT masked) AS hardest, count(*) AS size, avg(age) AS age FROM mm GROUP BY 1, 2)
SELECT batch, max(size) AS size, round(max(size) / 128, 6) AS fill, round(avg(age), 6) AS age, round(avg(hardest), 6) AS hardest FROM per GROUP BY 1""",
    "memory_state": "WITH b AS (SELECT event_id // 2560 AS epoch, event_id // 32 AS batch, count(*) AS n FROM events GROUP BY 1, 2) SELECT epoch, batch, CAST(least(coalesce(sum(n) OVER w, 0), 128) AS BIGINT) AS filled, count(*) OVER w AS clock FROM b WINDOW w AS (PARTITION BY epoch ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "masked_pairs": SEQ + "SELECT batch, count(*) AS n, sum(masked::INT)::BIGINT AS masked FROM pp GROUP BY 1",
    "similarity_diagnostics": SEQ
    + """, c AS (SELECT *, count(*) OVER (PARTITION BY batch, i) AS n FROM pp)
SELECT batch, round(avg(sim) FILTER (own), 6) AS positive, round(avg(sim) FILTER (j = xor(i, 1)), 6) AS paired, round(avg(sim) FILTER (j = (i - 1 + n) % n), 6) AS random, round(avg((sim > 0)::INT), 6) AS above_zero FROM c GROUP BY 1""",
    "loss_weights_dwa": _LOSS
    + """, r AS (SELECT epoch, step, exp(lag(a, 1) OVER w / greatest(lag(a, 2) OVER w, 1e-8) / 2) AS a, exp(lag(b, 1) OVER w / greatest(lag(b, 2) OVER w, 1e-8) / 2) AS b, exp(lag(c, 1) OVER w / greatest(lag(c, 2) OVER w, 1e-8) / 2) AS c FROM l WINDOW w AS (PARTITION BY epoch ORDER BY step))
SELECT epoch, step, round(coalesce(3 * a / (a + b + c), 1), 6) AS w_a, round(coalesce(3 * b / (a + b + c), 1), 6) AS w_b, round(coalesce(3 * c / (a + b + c), 1), 6) AS w_c FROM r""",
    "weighted_losses": _LOSS
    + """, s AS (SELECT *, step % 10 / CAST(10 AS DOUBLE) AS s1, -(step % 10 / CAST(5 AS DOUBLE)) AS s2 FROM l)
SELECT step, round(a + 0.5::DOUBLE * b, 6) AS fixed, round(exp(-s1) * a + s1 + exp(-s2) * 0.5::DOUBLE * b + s2, 6) AS uncertainty FROM s""",
    "lr_schedule": """WITH s AS (SELECT DISTINCT event_id // 32 AS step FROM events), t AS (SELECT greatest(1, max(step) - 5)::DOUBLE AS wide FROM s)
SELECT step, round(CASE WHEN step < 5 THEN (step + 1) / 5 ELSE 0.5::DOUBLE * (1 + cos(pi() * least(1, (step - 5) / wide))) END, 6) AS factor FROM s, t""",
    "early_stop": _LOG
    + f""", l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM lg),
f AS (SELECT DISTINCT run, 0::BIGINT AS k, (-1.0)::DOUBLE AS best, (-1)::BIGINT AS best_step, 0 AS bad, (-1)::BIGINT AS stop_step FROM lg
  UNION ALL SELECT run, k, CASE WHEN good THEN map ELSE best END, CASE WHEN good THEN step ELSE best_step END, CASE WHEN good THEN 0 ELSE bad + 1 END, CASE WHEN NOT good AND bad + 1 >= {PATIENCE} THEN step ELSE -1 END
  FROM (SELECT f.best, f.best_step, f.bad, l.*, l.map > f.best AND l.r10 >= {FLOOR} AS good FROM f JOIN l ON l.run = f.run AND l.k = f.k + 1 WHERE f.stop_step < 0) l)
SELECT run, best_step, best, bad, stop_step FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1""",
    "checkpoint_select": _LOG
    + f"""SELECT run, 'retriever' AS kind, step FROM lg QUALIFY row_number() OVER (PARTITION BY run ORDER BY r10 DESC, r1 DESC, step) = 1
UNION ALL (SELECT run, 'reranker', step FROM lg WHERE r10 >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY run ORDER BY map DESC, step) = 1)""",
    "report_table": retrieval.FXE
    + """, m AS (SELECT q_label AS label, avg(1.0 / rank) AS map, avg((rank <= 1)::INT) AS r1, avg((rank <= 5)::INT) AS r5 FROM rk JOIN (SELECT query_id, q_label FROM qs) USING (query_id) GROUP BY 1)
SELECT 'label ' || label AS name, printf('%.2f', round(map * 100, 2)) AS map, printf('%.2f', round(r1 * 100, 2)) AS r1, printf('%.2f', round(r5 * 100, 2)) AS r5 FROM m WHERE label % 3 <> 0""",
    "itm_pairs_sampled": SEQ
    + """, u AS (SELECT batch, i, j, sim, masked OR own AS no, -ln(-ln(greatest(least(CAST('0x' || substr(sha256('2026:' || batch || ':' || i || ':' || j), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE), 1 - 1e-12::DOUBLE), 1e-12::DOUBLE))) AS noise FROM pp)
SELECT batch, i, coalesce(max_by(j, sim / 0.07::DOUBLE + noise) FILTER (NOT no), max_by(j, noise) FILTER (i <> j)) AS j FROM u GROUP BY 1, 2""",
}
