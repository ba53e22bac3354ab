"""What bounds the work of queries on large tables, and that it changes no value."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import mtree
from brindle.operators import blocks, losses
from brindle.plans import registry


def sequence(spark, n=200):
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, (20, 4)).astype(np.float32)
    vectors = spark.createDataFrame([(k * 3, x.tolist()) for k, x in enumerate(v)], "vec_id long, vec array<float>")
    rows = [(k, k // 4, k // 80, k % 4, k % 5 if k % 9 else None, f"c{k % 7}", 3 * (k % 21), 3 * (k * 7 % 20)) for k in range(n) if k % 11]  # some rows' img is in no vector
    return spark.createDataFrame(rows, "seq long, batch long, epoch long, pos long, instance long, caption string, img long, txt long"), vectors


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_memory_in_spans_of_batches(spark, monkeypatch, most):
    """Vectors held by the workers or joined, groups of three batches, a memory that reaches over several of them."""
    monkeypatch.setattr(losses, "SPAN", 3)
    monkeypatch.setattr(losses, "HELD", most)
    keys, vectors = sequence(spark)
    rows = keys
    for side in ("img", "txt"):
        rows = rows.join(vectors.select(F.col("vec_id").alias(side), F.col("vec").alias("v")), side).drop(side).withColumnRenamed("v", side)
    p = losses.masked(losses.memory_pairs(rows, 30, 4).withColumn("own", F.lit(False)))
    per = p.groupBy("batch", "i").agg(F.max(F.when(~F.col("masked"), F.col("sim"))).alias("hardest"), F.count("*").alias("size"), F.avg("age").alias("age"))
    want = {r.batch: tuple(r)[1:] for r in per.groupBy("batch").agg(F.max("size"), F.avg("age"), F.avg("hardest")).collect()}
    got = {r.batch: tuple(r)[1:] for r in losses.memory_diagnostics_of_batches(keys, 30, 4, vectors).collect()}
    assert got.keys() == want.keys() and all((a is None) == (b is None) and (a is None or math.isclose(a, b)) for k in want for a, b in zip(got[k], want[k], strict=True))
    loss = [{r.batch: r.loss for r in losses.memory_loss_of_batches(*x).collect()} for x in ((keys, 30, 0.07, 4, vectors), (rows, 30, 0.07, 4))]
    cols = ["batch", "i", "i_instance", "j_instance", "i_caption", "j_caption", "sim", "own"]
    pairs = losses.in_batch_pairs(rows, 4).withColumn("own", F.col("i") == F.col("j")).select(*cols).unionByName(p.select(*cols))
    want = {r.batch: r.loss for r in losses.memory_loss(losses.masked(pairs.withColumns({c: F.coalesce(c, F.monotonically_increasing_id() + 99) for c in ("i_instance", "j_instance")})), 0.07).collect()}
    for x in loss:
        assert x.keys() == want.keys() and all(math.isclose(x[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("name", ["memory_loss", "memory_diagnostics"])
def test_held_vectors_are_not_shuffled(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" in plan and "embedding" not in plan.replace("embeddings.parquet", "")


@pytest.mark.parametrize("size, sample", [(10**6, 8), (20, 200)])
def test_average_precision_in_rounds_of_queries(spark, monkeypatch, size, sample):
    """No round deals out more than its share of the pairs, and the values are those of one round."""
    rng = np.random.default_rng(3)
    gallery = spark.createDataFrame([(k, rng.integers(-3, 4, 4).astype(float).tolist(), k % 5) for k in range(200)], "gallery_id long, vec array<float>, label int")
    queries = spark.createDataFrame([(k, rng.integers(-3, 4, 4).astype(float).tolist(), k % 6) for k in range(30)], "query_id long, vec array<float>, label int")
    met, seen = blocks._met, []
    monkeypatch.setattr(blocks, "_met", lambda q, g, *a: (seen.append(q.count() * g.count()), met(q, g, *a))[1])
    got = []
    for pairs in (1 << 25, 1500):
        monkeypatch.setattr(blocks, "ROUND", pairs)
        got.append({r.query_id: r.ap for r in blocks.average_precision(queries, gallery, dim=4, size=size, sample=sample).collect()})
    assert got[0] == got[1] and set(got[0]) == {k for k in range(30) if k % 6 < 5}
    assert seen[0] == 6000 and len(seen) > 4 and sum(seen[1:]) == 6000 and max(seen[1:]) < 4000


def test_pivots_are_compared_in_steps():
    """Products of a batch's rows with thousands of pivots would take hundreds of MB in each Python worker."""
    rng = np.random.default_rng(1)
    x, pivots = rng.normal(size=(6000, 65)), rng.normal(size=(3000, 65))
    tracemalloc.start()
    near, d = mtree._nearest(x, pivots)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    for k in (0, 349, 350, 5999):
        assert near[k] == mtree._distances(pivots, x[k]).argmin() and math.isclose(d[k], mtree._distances(pivots, x[k]).min())
    assert len(mtree._nearest(x[:0], pivots)[0]) == 0
