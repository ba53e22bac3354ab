import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry, text
from brindle.operators import batching, ordering, sampling, splits
from brindle.operators.components import connected
from brindle.operators.guards import ContractError, assert_empty, assert_ratios, duplicates, missing
from brindle.sources import tables


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[200] == 200


def test_cross_video_pair_stays_together(spark):
    rows = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (3, 3, 3), (4, 4, 4)], "image_id long, hard_id long, video_id long")
    c = splits.video_components(rows)
    s = splits.by_video(c, splits.deal(splits.component_sizes(rows, c)))
    got = {r.video_id: r.split for r in s.collect()}
    assert got[1] == got[2] and len(got) == 4
    assert splits.leakage(rows, s).count() == 0


def test_missing_target_is_found(spark):
    rows = spark.createDataFrame([(1, 9)], "image_id long, hard_id long")
    with pytest.raises(ContractError, match="hard targets"):
        assert_empty(missing(rows.select(F.col("hard_id").alias("image_id")), rows, "image_id"), "missing hard targets")
    with pytest.raises(ContractError):
        assert_ratios({"a": 0.5, "b": 0.6})


@pytest.mark.parametrize("n, want", [(7, (3, 2, 2)), (100, (37, 34, 29)), (1000, (371, 344, 285)), (2000, (742, 688, 570)), (5000, (1855, 1720, 1425)), (50000, (18555, 17199, 14246))])
def test_quotas(n, want):
    assert tuple(sampling.quotas(n).values()) == want


def test_quota_query_equals_the_helper(spark):
    got = {(r.n, r.bucket): r.quota for r in sampling.quota_table(spark.createDataFrame([(7,), (30000,)], "n long")).collect()}
    assert got == {(n, b): q for n in (7, 30000) for b, q in sampling.quotas(n).items()}


def test_pair_batches(spark):
    pairs = spark.createDataFrame([(0, 1, "A"), (2, 3, "A"), (4, 5, "A"), (6, 7, "B"), (8, 9, "C"), (10, 11, "D")], "a long, b long, grp string")
    rows = batching.pair_batches(pairs, 2, 0).collect()
    assert len(rows) == 6 and len({(r.a, r.b) for r in rows}) == 6
    two = batching.pair_batches(pairs, 4, 0).collect()
    by = {}
    for r in two:
        by.setdefault(r.batch, []).append(r.grp)
    assert all(len(v) == 2 == len(set(v)) for v in by.values())
    with pytest.raises(ValueError):
        batching.pair_batches(pairs, 5, 0)


def test_partner_index_and_match_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, "A"), (2, 3, "B")], "a long, b long, grp string")
    rows = batching.unpaired(batching.pair_batches(pairs, 4, 0))
    assert [r.partner_pos for r in rows.orderBy("pos").collect()] == [1, 0, 3, 2]
    m = batching.match_pairs(rows, ["batch"]).collect()
    assert len(m) == 12 and sum(r.label for r in m) == 4


def test_mixed_batches_hold_rows_once(spark):
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1, k) for k in range(4)], "a long, b long, grp long")
    rows = spark.range(12).select(F.col("id").alias("row_id"))
    got = batching.mixed_batches(pairs, rows, 8, 2, 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append((r.pos, r.row_id))
    assert len(by) == 2
    for v in by.values():
        ids = [i for _, i in sorted(v)]
        assert len(ids) == 8 == len(set(ids)) and ids[0] // 2 == ids[1] // 2 and ids[2] // 2 == ids[3] // 2
    with pytest.raises(ValueError):
        batching.mixed_batches(pairs, rows, 8, 5, 0)


def test_text_rules(spark):
    d = spark.createDataFrame([("Enhanced caption:  **A  dog**", "a dog", "anomaly"), ("", "keep me", "normal"), ("'x y'", "x y", "normal")], "raw string, original string, label_type string")
    got = [r[0] for r in d.select(text.finalize(F.col("original"), F.col("raw"), F.col("label_type"))).collect()]
    assert got == ["a dog", "keep me", "x y"]
    assert spark.range(1).select(text.text_key(F.lit(" A \tb  C "))).first()[0] == "a b c"
    assert spark.range(1).select(text.bucket_of_path(F.lit("x\\full\\1.jpg")), text.webp_path(F.lit("train/a/b.c/1.jpg"))).first()[0:2] == ("full", "a/b.c/1.webp")


def test_tokenizer_keeps_the_first_98_words_and_gives_a_mask(spark, tmp_path):
    from brindle.plans import dataset

    texts = [" ".join(f"w{k}" for k in range(200)), "A  dog", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'aa' AS lang", "'s' AS source", "0L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.image_id: r for r in dataset.tokenizer(spark, str(tmp_path)).collect()}
    ids = {k: [int(x) for x in got[k].ids.split()] for k in range(3)}
    assert [got[k].mask.count("1") for k in range(3)] == [100, 4, 2] and all(len(ids[k]) == 100 == len(got[k].mask) for k in range(3))
    assert ids[0][0] == 1 and ids[0][99] == 2 and len(set(ids[0][1:99])) > 90 and ids[1][3:5] == [2, 0]
    assert all((i != 0) == (m == "1") for k in range(3) for i, m in zip(ids[k], got[k].mask, strict=True))


def test_numbers_within_groups(spark):
    rows = [(None if k % 11 == 0 else "a" if k % 3 else "b", k % 7, k) for k in range(400)] + [("only", 1, 1000)]
    d = spark.createDataFrame(rows, "grp string, x int, id long")
    got = {r.id: r.rn for r in ordering.segmented(d, ["grp"], ["x", "id"], partitions=9).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[2]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert got == want
    assert ordering.segmented(d.where("id < 0"), ["grp"], ["x"]).count() == 0
    assert [r.rn for r in ordering.numbered(d, ["x", "id"], 5).orderBy("x", "id").collect()] == list(range(1, 402))


def test_grouped_batches_walk_through_laps(spark):
    sizes = {"a": 50, "b": 9, "c": 3, None: 20}
    rows = [(k, g) for k, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    of = dict(rows)
    got = batching.grouped_batches(spark.createDataFrame(rows, "row_id long, grp string"), 8, 0.5, 1).collect()
    batches = {}
    for r in got:
        batches.setdefault(r.batch, {})[r.pos] = r.row_id
    assert sorted(batches) == list(range(82 // 8)) and all(sorted(b) == list(range(8)) for b in batches.values())
    fill, seen = [], {}
    for n in sorted(batches):
        g = of[batches[n][0]]
        m = min(4, sizes[g])
        part = [batches[n][k] for k in range(m)]
        assert {of[i] for i in part} == {g} and len(set(part)) == m
        seen.setdefault(g, []).append(part)
        fill += [batches[n][k] for k in range(m, 8)]
    assert len(fill) == len(set(fill)) and None not in seen
    for g, parts in seen.items():
        lap = sizes[g] // min(4, sizes[g])
        for k in range(0, len(parts), lap):
            rows_of_lap = [i for p in parts[k : k + lap] for i in p]
            assert len(rows_of_lap) == len(set(rows_of_lap))  # a lap repeats no row


def test_boxes(spark):
    b = F.array(*[F.lit(x) for x in (0.2, 0.2, 0.2, 0.6)])
    assert spark.range(1).select(geometry.xyxy_to_xywh(b)).first()[0][2] == 1e-6
    assert spark.range(1).select(geometry.xyxy_to_xywh(F.array(F.lit(1.0)))).first()[0] is None


def test_duplicates(spark):
    assert [r.id for r in duplicates(spark.createDataFrame([(1,), (1,), (2,)], "id int"), "id").collect()] == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "attr_2.json").write_text('{"image_id": "a", "video_id": 1}\n\n{"image_id": "b", "video_id": 2}\n')
    got = tables.read_annotations(spark, str(tmp_path / "attr_*.json")).orderBy("image_id").collect()
    assert [(r.image_id, r.file_no) for r in got] == [("a", 2), ("b", 2)]
    for k, items in enumerate(([{"image_id": "a", "status": "ok"}], {"a": {"status": "ok"}})):
        p = tmp_path / f"doc{k}.json"
        p.write_text(json.dumps({"items": items}))
        assert [tuple(r) for r in tables.read_items(spark, str(p), "status:string").select("image_id", "status").collect()] == [("a", "ok")]
    m = spark.createDataFrame([("a", "train"), ("b", "dev")], "image_id string, split string")
    tables.write_manifest(m, str(tmp_path / "m"))
    read = tables.read_manifest(spark, str(tmp_path / "m"), "dev")
    assert [r.image_id for r in read.collect()] == ["b"] and "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().toString()
    s = tables.shards(spark.range(10), "id", 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in s] == [4, 4, 2]
    assert tables.fingerprint(m).first() == tables.fingerprint(m.repartition(3)).first()
    x, y = (spark.createDataFrame([(k,) for k in v], "id string") for v in ("aabb", "ccdd"))
    assert tables.fingerprint(x).first() != tables.fingerprint(y).first() and tables.fingerprint(x.where("id = 'z'")).first().n == 0


def test_contracts_break_the_build(spark):
    rows = "image_id long, hard_id long, video_id long"
    with pytest.raises(ContractError, match="hard targets"):
        splits.video_components(spark.createDataFrame([(1, 9, 1)], rows))
    with pytest.raises(ContractError, match="several videos"):
        splits.video_components(spark.createDataFrame([(1, 2, 1), (1, 2, 2), (2, 1, 1)], rows))
    alone = splits.video_components(spark.createDataFrame([(1, None, 7), (2, 3, 8), (3, 2, 8)], rows))
    assert {(r.video_id, r.component) for r in alone.collect()} == {(7, 7), (8, 8)}


def one_by_one(sizes, ratios):
    total = sum(n for _, n in sizes)
    target, held, out = {k: total * r for k, r in ratios.items()}, dict.fromkeys(ratios, 0), {}
    for c, n in sizes:
        k = min(ratios, key=lambda k: (-((target[k] - held[k]) / target[k]), held[k], list(ratios).index(k)))
        held[k] += n
        out[c] = k
    return out


@pytest.mark.parametrize("ratios", [splits.RATIOS, {"a": 0.5, "b": 0.5}, {"a": 0.7, "b": 0.2, "c": 0.06, "d": 0.04}])
def test_deal_equals_one_decision_after_the_other(spark, ratios):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(k, rng.choice([1, 1, 1, 2, 3, 5, 8, 40])) for k in range(700)], "component long, n_rows long")
    order = splits.ordered(sizes, 2026).orderBy(F.desc("n_rows"), "key", "component").collect()
    got = {r.component: r.split for r in splits.deal(sizes, ratios).collect()}
    assert got == one_by_one([(r.component, r.n_rows) for r in order], ratios)


@pytest.mark.parametrize("sizes, k", [([30, 1, 1], 2), ([5, 5, 5, 1], 4), ([1] * 23, 5), ([7, 6, 2, 2, 1, 1, 1], 3), ([4], 2), ([1, 1], 3)])
def test_pair_batches_lose_only_the_tail(spark, sizes, k):
    pairs = [(g * 1000 + j, -(g * 1000 + j), g) for g, n in enumerate(sizes) for j in range(n)]
    got = batching.pair_batches(spark.createDataFrame(pairs, "a long, b long, grp long"), 2 * k, 1).collect()
    full = max(n for n in range(sum(sizes) // k + 1) if sum(min(s, n) for s in sizes) >= n * k)
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append((r.slot, r.grp))
    assert sorted(by) == list(range(full)) and len({r.a for r in got}) == len(got)
    assert all(sorted(s for s, _ in v) == list(range(k)) and len({g for _, g in v}) == k for v in by.values())


def test_nested_subsets_look_further_when_texts_repeat(spark):
    rows = [(100 * b + k, name, k + 1, f"same{b}" if k < 60 else f"t{b}-{k}", f"h{b}-{k}") for b, name in enumerate(text.BUCKETS) for k in range(90)]
    d = spark.createDataFrame(rows, "image_id long, bucket string, ord int, key string, hard_key string")
    got = sampling.nested_subsets(d, [3, 9]).collect()
    small, large = ({r.image_id for r in got if r.size == n} for n in (3, 9))
    assert small < large and len(small) == 3 and len(large) == 9 and all(i % 100 == 0 or i % 100 >= 60 for i in large)
    with pytest.raises(Exception, match="exhausted"):
        sampling.nested_subsets(d, [300])
