"""Exact search and hard negatives against plain numpy and DuckDB, on awkward rows: ties, repeats, odd components, few rows."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import mtree, pq, queries, vectors

ROWS = "vec_id long, embedding array<float>, label int, cell int, q string"


def table(spark, rows):
    """Columns named like the operators' own beside those that they take."""
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], ROWS)


def odd_rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.1 * r.normal(size=8)).astype(np.float32).tolist(), int(k % 4)) for k in range(500)]
    rows += [(1000 + k, rows[3][1], int(k % 3)) for k in range(300)]  # a large group of equal vectors
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [math.nan] + [0.0] * 7, 1), (2050, [math.inf] + [0.0] * 7, 2), (None, [1.0] * 8, 1), (2100, [0.0] * 8, None), (2150, [0.5] * 3, 1), (2151, [-0.001] * 8, 9)]
    rows += [rows[50], rows[50], rows[7], (100, [0.25] * 8, 1)]  # repeated rows, and an id with two vectors
    return rows


def whole(rows):
    """(id, vector, label) of the rows that take part, padded to the longest."""
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), label) for i, v, label in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dim = max((len(v) for _, v, _ in good), default=0)
    return [(i, np.pad(v, (0, dim - len(v))), label) for i, v, label in good]


def asked(good, every):
    one = {}
    for i, v, label in good:
        if i % every == 0:
            one[i] = min(one.get(i, (tuple(v), label)), (tuple(v), label))
    return one


def plain_top(rows, every, k):
    good = whole(rows)
    out = []
    for q, (v, _) in asked(good, every).items():
        best = sorted((-int(np.dot(v, x)), i) for i, x, _ in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def plain_negatives(rows, every):
    good = [x for x in whole(rows) if x[2] is not None]
    out = []
    for a, (v, label) in asked(good, every).items():
        s = sorted((-int(np.dot(v, x)), i, other == label) for i, x, other in good if i != a)
        for p, ps in sorted({(i, -x) for x, i, same in [x for x in s if x[2]][:5]}):
            hits = [(i, -x) for x, i, same in s if not same and 50 * ps <= -100 * x <= 95 * ps][:3]
            out += [(a, p, n + 1, i, ps, x) for n, (i, x) in enumerate(hits)]
    return sorted(out)


def top(spark, rows, every, k):
    t = vectors.scaled(table(spark, rows))
    return sorted(tuple(r) for r in mtree.top_k(t, t.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), k).collect())


def negatives(spark, rows, every):
    t = vectors.scaled(table(spark, rows), "label")
    return sorted(tuple(r) for r in pq.mine(t, t.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"), "label")).collect())


def test_top_k_of_odd_rows(spark):
    assert top(spark, odd_rows(), 50, 5) == plain_top(odd_rows(), 50, 5)


def test_top_k_of_many_trees(spark, monkeypatch):
    """Small trees and pages: bounds between pivots, trees and pages are all used."""
    monkeypatch.setattr(mtree, "TREE", 40)
    monkeypatch.setattr(mtree, "PIVOTS", (5, 9))
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 7)
    assert top(spark, odd_rows(), 25, 4) == plain_top(odd_rows(), 25, 4)


def test_bounds_avoid_computations(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.02 * r.normal(size=16)).astype(np.float32).tolist(), 0) for k in range(6000)]
    t = vectors.scaled(table(spark, rows))
    forest = mtree.Forest(t)
    found, work = forest.search(t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 5)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 50, 5)
    assert work.agg(F.avg("computed")).first()[0] < 0.3 * len(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (50, [0.0, -1.0], 2)]
    assert top(spark, rows, 50, 5) == plain_top(rows, 50, 5)
    assert top(spark, rows[:1], 50, 5) == [] and top(spark, [], 50, 5) == []
    assert negatives(spark, rows, 50) == plain_negatives(rows, 50)
    assert negatives(spark, rows[:1], 50) == [] and negatives(spark, [], 50) == []


def test_negatives_of_odd_rows(spark, monkeypatch):
    assert negatives(spark, odd_rows(), 25) == plain_negatives(odd_rows(), 25)
    monkeypatch.setattr(pq, "BLOCK", 37)
    monkeypatch.setattr(pq, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(pq, "CENTRES", 8)
    assert negatives(spark, odd_rows(), 25) == plain_negatives(odd_rows(), 25)


def test_bounds_hold_all_scores():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(700, 10)))
    books = pq.codebooks(x[:300], centres=16)
    codes, left = pq.encode(x, books)
    block = pq._Block(pa.table({"vec_id": np.arange(700), "v": vectors.lists(x), "label": np.zeros(700, np.int64), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "left": vectors.lists(left)}), books, 10)
    for q in x[:40]:
        low, high = block.bounds(q)
        s = x @ q
        assert (low <= s).all() and (s <= high).all() and (high - low).mean() < np.ptp(s)


def test_window():
    for p in range(-30, 400):
        lo, hi = pq.window(p)
        assert [s for s in range(-100, 500) if 50 * p <= 100 * s <= 95 * p] == list(range(lo, hi + 1))


@pytest.mark.parametrize("name", ["op11_topk", "op12_hard_negatives"])
def test_queries_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    con.execute(queries.oracle_sql()[name])
    assert sorted(tuple(r) for r in queries.queries()[name](spark, sf).collect()) == sorted(con.fetchall())
