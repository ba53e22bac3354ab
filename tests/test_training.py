import math

import numpy as np
from pyspark.sql import functions as F

from brindle.functions.vector import dot, l2_normalize, norm
from brindle.operators import experiment, losses
from brindle.streaming import jobs


def pairs(spark, sim, inst=None, cap=None):
    n, m = sim.shape
    inst, cap = inst or list(range(n)), cap or [str(k) for k in range(n)]
    return spark.createDataFrame([(0, i, j, float(sim[i, j]), inst[i], inst[j], cap[i], cap[j], i == j) for i in range(n) for j in range(m)], "batch int, i int, j int, sim double, i_instance int, j_instance int, i_caption string, j_caption string, own boolean")


def test_itc_equals_infonce_for_unique_ids(spark):
    rng = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(5, 16)), rng.normal(size=(5, 16))))
    s = a @ b.T
    x = s / 0.05
    want = -(np.diag(x) - np.log(np.exp(x).sum(1))).mean() / 2 - (np.diag(x) - np.log(np.exp(x).sum(0))).mean() / 2
    assert math.isclose(losses.itc(pairs(spark, s), 0.05).first().loss, want, abs_tol=1e-9)


def test_smooth_ap_extremes(spark):
    first, last = np.array([[5.0, 0, -5]]), np.array([[-5.0, 0, 5]])
    full = lambda s: np.vstack([s, s, s])
    good = losses.smooth_ap(pairs(spark, full(first)).where("i = 0"), 0.01).first().loss
    bad = losses.smooth_ap(pairs(spark, full(last)).where("i = 0"), 0.01).first().loss
    assert good < 1e-2 < bad


def test_memory_window_wraps(spark):
    v = [1.0, 0.0]
    rows = spark.createDataFrame([(k, k // 4, 0, k % 4, k, str(k), v, v) for k in range(12)], "seq long, batch long, epoch long, pos long, instance long, caption string, img array<double>, txt array<double>")
    got = {r.batch: (r.slots, r.age) for r in losses.memory_pairs(rows, 6, 2).groupBy("batch").agg(F.count_distinct("j").alias("slots"), F.max("age").alias("age")).collect()}
    assert got == {1: (4, 1), 2: (6, 2)}


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<float>, b array<float>")
    r = d.select(dot(F.col("a"), F.col("b"), 2), norm(F.col("a")), l2_normalize(F.col("a"))).first()
    assert r[0] == 11 and r[1] == 5 and np.allclose(r[2], [0.6, 0.8])


def test_early_stop_and_selection(spark):
    log = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.6, 0.8), (3, 0.4, 0.9), (4, 0.3, 0.9), (5, 0.9, 0.9)], "step long, map double, r10 double")
    r = experiment.early_stop(log, 3, 0.85).first()
    assert (r.best_step, r.bad, r.stop_step) == (1, 3, 4)


def _stream(spark, df, path, n=3):
    for k in range(n):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_ring_memory_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(e, 10 * e + b, 4, b % 3) for e in range(2) for b in range(6)], "epoch long, batch long, n long, part int").orderBy("batch")
    rows = rows.withColumn("part", F.floor(F.col("batch") % 10 / 2).cast("int"))
    _run(jobs.ring_memory(_stream(spark, rows, str(tmp_path / "in")), 10), "ring")
    got = {(r.epoch, r.batch): (r.filled, r.clock) for r in spark.table("ring").collect()}
    assert got == {(e, 10 * e + b): (min(4 * b, 10), b) for e in range(2) for b in range(6)}


def test_metric_log_stream_equals_fold(spark, tmp_path):
    log = [(1, 0.5, 0.9), (2, 0.6, 0.8), (3, 0.4, 0.9), (4, 0.3, 0.9), (5, 0.9, 0.9)]
    rows = spark.createDataFrame([("a", s, m, r, k // 2) for k, (s, m, r) in enumerate(log)], "run string, step long, map double, r10 double, part int")
    _run(jobs.best_so_far(_stream(spark, rows, str(tmp_path / "in")), 0.85, 3), "best")
    last = spark.table("best").where("step = 5").first()
    assert (last.best, last.bad, last.stopped) == (0.5, 3, True)


def test_work_queue_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{k % 4}", k % 2) for k in range(8)], "task_key string, part int")
    s = _stream(spark, rows, str(tmp_path / "in"), 2)
    for c in ("c1", "c2"):  # the second run starts from nothing but the log
        jobs.work_queue(s, str(tmp_path / "done"), str(tmp_path / c), lambda d: d.withColumn("output", F.upper("task_key"))).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "done"))
    assert sorted(r.task_key for r in got.collect()) == ["t0", "t1", "t2", "t3"]
    assert {r.task_key: r.output for r in jobs.replay(got).collect()}["t1"] == "T1"


def test_score_stream(spark):
    got = jobs.score_stream(spark.range(3), lambda f: f["id"] * 2).orderBy("id").collect()
    assert [r.score for r in got] == [0, 2, 4]


def test_batches_as_matrices_equal_pair_tables(spark):
    rng = np.random.default_rng(3)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist())(rng.normal(size=8))
    data = [(k, k // 5, k // 20, k % 5, int(rng.integers(0, 9)), str(rng.integers(0, 12)), unit(), unit()) for k in range(63)]
    rows = spark.createDataFrame(data, "seq long, batch long, epoch long, pos long, instance long, caption string, img array<float>, txt array<float>")
    p = losses.in_batch_pairs(rows, 8).withColumn("own", F.col("i") == F.col("j"))
    both = lambda a, b: ({r.batch: r.loss for r in a.collect()}, {r.batch: r.loss for r in b.collect()})
    cols = ["batch", "i", "i_instance", "j_instance", "i_caption", "j_caption", "sim", "own"]
    memory = losses.memory_pairs(rows, 12, 8).withColumn("own", F.lit(False))
    cases = [
        both(losses.itc(p, 0.07), losses.itc_of_batches(rows, 0.07, 8)), both(losses.smooth_ap(p, 0.01), losses.smooth_ap_of_batches(rows, 0.01, 8)),
        both(losses.memory_loss(losses.masked(p.select(*cols).unionByName(memory.select(*cols))), 0.07), losses.memory_loss_of_batches(rows, 12, 0.07, 8)),
        both(losses.memory_loss(losses.masked(p.select(*cols)), 0.07), losses.memory_loss_of_batches(rows, 0, 0.07, 8)),
    ]
    for a, b in cases:
        assert len(a) == 13 and a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
