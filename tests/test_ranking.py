import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import assignment, blocks, ranking


def scored(spark, sim, gt):
    return spark.createDataFrame([(q, g, float(x), float(row[gt[q]])) for q, row in enumerate(sim) for g, x in enumerate(row)], "query_id long, gallery_id long, score double, gt_score double")


def order(spark, ids, scores):
    return spark.createDataFrame([(q, int(g), float(s), k + 1) for q, (r, t) in enumerate(zip(ids, scores)) for k, (g, s) in enumerate(zip(r, t))], "query_id long, gallery_id long, score double, pos int")


def ranks(df):
    return [r["rank"] for r in df.orderBy("query_id").collect()]


def tops(df):
    return [r.gallery_id for r in df.where("pos = 1").orderBy("query_id").collect()]


def test_rank_and_report(spark):
    r = ranking.rank_of_truth(scored(spark, [[0.9, 0.1, 0.5], [0.2, 0.8, 0.5]], [0, 2]))
    assert ranks(r) == [1, 2]
    rep = ranking.report(r, (1, 2)).first()
    assert (rep["map"], rep.r1, rep.r2) == (0.75, 0.5, 1.0)


def test_rank_is_pessimistic_on_ties(spark):
    assert ranks(ranking.rank_of_truth(scored(spark, [[0.5, 0.5, 0.5]], [0]))) == [3]


def test_average_precision_equals_the_textbook(spark):
    rng = np.random.default_rng(1)
    sim, rel = rng.random((4, 15)), (rng.random((4, 15)) < 0.4).astype(int)
    rel[:, 0] = 1
    rows, want = [], []
    for q in range(4):
        o = np.argsort(-sim[q])
        hits = np.cumsum(rel[q][o])
        want.append((hits / np.arange(1, 16) * rel[q][o]).sum() / rel[q].sum())
        rows += [(q, k + 1, int(rel[q][g])) for k, g in enumerate(o)]
    got = [r.ap for r in ranking.average_precision(spark.createDataFrame(rows, "query_id long, rank int, relevant int")).orderBy("query_id").collect()]
    assert np.allclose(got, want)


def test_minmax_of_a_tied_row_is_zero(spark):
    d = order(spark, [[0, 1], [0, 1]], [[2, 2], [1, 3]]).withColumn("n", ranking.minmax(F.col("score"), ["query_id"]))
    assert [r.n for r in d.orderBy("query_id", "pos").collect()] == [0, 0, 0, 1]


def test_rerank_keeps_ids_with_scores(spark):
    d = ranking.rerank(order(spark, [[8, 3, 5]], [[0.1, 0.8, 0.4]]), ["query_id"], "score")
    assert [(r.gallery_id, r.score) for r in d.orderBy("pos").collect()] == [(3, 0.8), (5, 0.4), (8, 0.1)]


def test_rank_outside_the_candidates(spark):
    o = order(spark, [[1, 0]], [[0.8, 0.9]])
    truth = spark.createDataFrame([(0, 2, 3, 2)], "query_id long, gt_id long, first_rank long, above long")
    assert ranks(ranking.rank_after_rerank(o, truth, 2)) == [3]


def test_stable_matching_removes_a_conflict(spark):
    o = order(spark, [[0, 1, 2], [0, 2, 1]], [[0.9, 0.5, 0.1], [0.8, 0.7, 0.2]])
    assert ranking.top1_conflicts(o).first().conflicts == 1
    new = assignment.resolve(o, "stable")
    assert ranking.top1_conflicts(new).first().conflicts == 0 and tops(new) == [0, 2]


def test_greedy_keeps_membership(spark):
    o = order(spark, [[0, 1, 2], [0, 2, 1]], [[0.9, 0.5, 0.1], [0.8, 0.7, 0.2]])
    new = assignment.resolve(o, "greedy")
    assert ranking.top1_conflicts(new).first().conflicts == 0
    assert {r.query_id: sorted(r.g) for r in new.groupBy("query_id").agg(F.collect_list("gallery_id").alias("g")).collect()} == {0: [0, 1, 2], 1: [0, 1, 2]}


def test_greedy_with_three_claims(spark):
    o = order(spark, [[0, 1, 2], [0, 2, 1], [0, 3, 4]], [[0.9, 0.5, 0.1], [0.8, 0.7, 0.2], [0.7, 0.6, 0.1]])
    assert tops(assignment.resolve(o, "greedy")) == [0, 2, 3]


def test_matching_has_no_blocking_pair(spark):
    rng = np.random.default_rng(5)
    s = rng.random((8, 6))
    m = assignment.stable_match(order(spark, [range(6)] * 8, s)).collect()
    q, g = {r.query_id: r.gallery_id for r in m}, {r.gallery_id: r.query_id for r in m}
    assert len(q) == len(g) == 6
    for a in range(8):
        for b in range(6):
            assert not (s[a, b] > (s[a, q[a]] if a in q else -1) and s[a, b] > s[g[b], b])


def one_by_one(lists, scores):
    """Greedy resolution by a walk over the losers."""
    tops = {q: x[0] for q, x in lists.items()}
    groups = {}
    for q in lists:
        groups.setdefault(tops[q], []).append(q)
    used, out = set(tops.values()), dict(tops)
    for g, qs in groups.items():
        keep = max(qs, key=lambda q: (scores[q][0], -q))
        for q in [x for x in qs if x != keep]:
            new = next((x for x in lists[q] if x not in used), None)
            if new is not None:
                used.add(new)
                out[q] = new
    return out


def test_conflicts_on_random_lists(spark):
    """Rounds give what a walk in order gives: greedy and stable resolution of crowded lists, with ties."""
    rng = np.random.default_rng(7)
    lists = {q: [int(g) for g in rng.choice(25, 6, replace=False)] for q in range(60)}
    scores = {q: sorted((float(x) for x in rng.integers(0, 9, 6)), reverse=True) for q in lists}
    for q in lists:  # equal scores: the smaller gallery id first
        both = sorted(zip(scores[q], lists[q], strict=True), key=lambda x: (-x[0], x[1]))
        lists[q], scores[q] = [g for _, g in both], [s for s, _ in both]
    o = order(spark, lists.values(), scores.values())
    got = {r.query_id: r.gallery_id for r in assignment.resolve(o, "greedy").where("pos = 1").collect()}
    assert got == one_by_one(lists, scores)
    edges = sorted((-s, q, g) for q in lists for s, g in zip(scores[q], lists[q], strict=True))
    queries, galleries, want = set(), set(), set()
    for _, q, g in edges:
        if q not in queries and g not in galleries:
            queries.add(q)
            galleries.add(g)
            want.add((q, g))
    assert {(r.query_id, r.gallery_id) for r in assignment.stable_match(o).collect()} == want


def test_matching_follows_a_chain(spark):
    """Each query displaces the next one."""
    chain = spark.createDataFrame([(q, q + d, float(q - d)) for q in range(8) for d in (0, 1)] + [(50, 50, 1.0)], "query_id long, gallery_id long, score double")
    got = {(r.query_id, r.gallery_id) for r in assignment.stable_match(chain).collect()}
    assert got == {(q, q) for q in range(8)} | {(50, 50)}


def blocks_case(spark, n=300):
    rng = np.random.default_rng(2)
    g = rng.integers(-9, 10, (n, 6)).astype(np.float32)  # whole numbers: scores are exact
    g[50:90] = g[7]  # equal rows: ties go by id
    q = rng.integers(-9, 10, (17, 6)).astype(np.float32)
    gallery = spark.createDataFrame([(k, v.tolist(), int(k % 5)) for k, v in enumerate(g)], "gallery_id long, vec array<float>, label int")
    queries = spark.createDataFrame([(k, k * 3, v.tolist(), int(k % 6)) for k, v in enumerate(q)], "query_id long, gt_id long, vec array<float>, label int")
    s = q.astype(float) @ g.astype(float).T
    return queries, gallery, s


def test_one_pass_over_all_pairs(spark, monkeypatch):
    queries, gallery, s = blocks_case(spark)
    monkeypatch.setattr(blocks, "BLOCK", 64)
    monkeypatch.setattr(blocks, "PART", 5)
    hits = blocks.scan(ranking.with_truth(queries, gallery, 6), gallery, 4, 6)
    got = {(r.query_id, r.pos): r.gallery_id for r in blocks.candidates(hits, 4).collect()}
    want = {(q, k + 1): int(g) for q, row in enumerate(s) for k, g in enumerate(np.lexsort((np.arange(len(row)), -np.round(row, 9)))[:4])}
    assert got == want
    rank = {r.query_id: (r["rank"], r.n) for r in blocks.ranks(hits).collect()}
    assert rank == {q: (int((row > row[q * 3] - 1e-9).sum()), len(row)) for q, row in enumerate(s)}


def test_average_precision_in_ranges_of_scores(spark):
    """One range, and many that cut between equal scores, give the textbook's value."""
    queries, gallery, s = blocks_case(spark)
    want = {}
    for q, row in enumerate(s):
        o = np.lexsort((np.arange(len(row)), -np.round(row, 9)))
        hit = np.flatnonzero(o % 5 == q % 6)
        if len(hit):
            want[q] = float((np.arange(1, len(hit) + 1) / (hit + 1)).mean())
    for size, sample in ((10**6, 8), (20, 200)):
        got = {r.query_id: r.ap for r in blocks.average_precision(queries, gallery, dim=6, size=size, sample=sample).collect()}
        assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        assignment.resolve(order(spark, [[0]], [[1]]), "other")
