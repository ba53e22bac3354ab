import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry, text
from brindle.operators import guards
from brindle.operators.guards import ContractError
from brindle.sources import caches, tables
from brindle.streaming import jobs


def test_candidates_and_scores_belong_together(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"i{k}") for k in range(4)], "row long, image_id string")
    cand = spark.createDataFrame([(q, g, 1.0 - p / 10, p) for q in range(3) for p, g in enumerate((q, q + 1), 1)], "query_id long, gallery_id long, score double, pos int")
    path = str(tmp_path / "c")
    caches.write_candidates(cand, rows, path, "report", 2)
    got = caches.read_candidates(spark, path, "report", rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cand.collect()))
    with pytest.raises(ContractError, match="split report, not dev"):
        caches.read_candidates(spark, path, "dev", rows)
    with pytest.raises(ContractError, match="rows differ"):
        caches.read_candidates(spark, path, "report", rows.withColumn("row", 3 - F.col("row")))
    caches.write_candidates(cand.where("NOT (query_id = 1 AND pos = 2)"), rows, str(tmp_path / "short"), "report", 2)
    with pytest.raises(ContractError, match="without k"):
        caches.read_candidates(spark, str(tmp_path / "short"), "report", rows)
    caches.write_scores(cand.withColumn("pair_score", F.col("pos") * 2.0), str(tmp_path / "s"))
    assert {r.pair_score for r in caches.read_scores(spark, str(tmp_path / "s"), got).collect()} == {2.0, 4.0}
    with pytest.raises(ContractError, match="don't match"):
        caches.read_scores(spark, str(tmp_path / "s"), got.where("pos = 1"))
    caches.write_ranking(got, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6


def test_text_features_by_key_then_by_id(spark):
    rows = spark.createDataFrame([(1, "A dog"), (2, "a cat")], "image_id long, caption string")
    key = rows.where("image_id = 1").select(text.cache_key(F.col("image_id"), text.caption_hash(F.col("caption")))).first()[0]
    feats = spark.createDataFrame([(key, [1.0]), ("1", [9.0]), ("2", [2.0])], "key string, feature array<double>")
    got = caches.with_text_features(rows, feats)
    assert got.columns == ["image_id", "caption", "feature"] and {r.image_id: r.feature for r in got.collect()} == {1: [1.0], 2: [2.0]}
    with pytest.raises(ContractError, match="without text features"):
        caches.with_text_features(rows, feats.where("key <> '2'"))


def test_repeated_feature_keys(spark):
    rows = spark.createDataFrame([(1, "A dog")], "image_id long, caption string")
    with pytest.raises(ContractError, match="repeated keys"):
        caches.with_text_features(rows, spark.createDataFrame([("1", [1.0]), ("1", [2.0])], "key string, feature array<double>"))


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ContractError, match="no version"):
        caches.current(spark, path)
    assert [caches.publish(spark.range(n), path) for n in (1, 2, 3)] == [1, 2, 3]
    assert caches.current(spark, path).count() == 3 and caches.current(spark, path, 2).count() == 2
    with pytest.raises(ContractError):
        caches.current(spark, path, 1)
    (tmp_path / "t" / "v-half-written").mkdir()  # a writer that broke off
    assert caches.current(spark, path).count() == 3
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 3


def test_logs_name_the_malformed_line(spark, tmp_path):
    lines = [f'{{"key": "k{n % 50}", "output": "o{n}"}}' for n in range(2000)]
    lines[3:3] = ["", "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"key": "k1", "output": "later"}\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits
    try:
        numbers = tables.read_lines(spark, str(tmp_path / "a.jsonl")).collect()
        assert {r.line: r.value for r in numbers} == dict(enumerate(lines, 1))
        last = {r.key: r.output for r in tables.last_records(tables.read_log(spark, str(tmp_path / "*.jsonl"), "key string, output string"), "key").collect()}
        assert last == {f"k{k}": f"o{1950 + k}" for k in range(50)} | {"k1": "later"}
        lines[1500] = '{"key": "k1", "out'
        (tmp_path / "a.jsonl").write_text("\n".join(lines))
        with pytest.raises(ContractError, match="a.jsonl, line 1501"):
            tables.read_log(spark, str(tmp_path / "*.jsonl"), "key string, output string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_scoring_counts_rows_and_time(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = jobs.score_stream(stream, lambda f: f["id"] * 2).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = jobs.throughput(query).collect()
    assert len(got) == 2 and sum(r.rows for r in got) == 40 and all(r.seconds > 0 and r.per_second > 0 and r.without == 0 for r in got)


def test_prefix_folders_images_and_shard_digests(spark, tmp_path):
    ids = spark.createDataFrame([(f"{k % 3}_{k}",) for k in range(12)], "id string")
    caches.write_by_prefix(ids, str(tmp_path / "p"), "id")
    assert sorted(x.name for x in (tmp_path / "p").glob("chunk=*")) == ["chunk=0", "chunk=1", "chunk=2"]
    (tmp_path / "i").mkdir()
    for k in range(3):
        (tmp_path / "i" / f"im{k}.webp").write_bytes(bytes([k]) * (k + 1))
    images = caches.read_images(spark, str(tmp_path / "i"))
    assert sorted((r.image_id, r.length) for r in images.collect()) == [("im0", 1), ("im1", 2), ("im2", 3)]
    got = {r.shard: (r.n, r.bytes, r.digest) for r in caches.shard_digests(tables.shards(images, "image_id", 2, 2), "image_id", "content").collect()}
    line = lambda k: f"im{k}:{hashlib.sha256(bytes([k]) * (k + 1)).hexdigest()}"
    assert got == {0: (2, 3, hashlib.sha256(f"{line(0)}\n{line(1)}".encode()).hexdigest()), 1: (1, 3, hashlib.sha256(line(2).encode()).hexdigest())}


def test_suite_pair_and_report_rules(spark):
    suite = lambda *rows: spark.createDataFrame(list(rows), "image_id long, split string, is_query boolean")
    good = suite((1, "dev", True), (2, "dev", False))
    guards.assert_suite(good, "dev")
    for bad, why in ((suite(), "empty"), (suite((1, "dev", True), (2, "report", False)), "another split"), (suite((1, "dev", False)), "no queries"), (suite((1, "dev", True), (1, "dev", False)), "duplicate")):
        with pytest.raises(ContractError, match=why):
            guards.assert_suite(bad, "dev")
    guards.assert_apart(good, suite((3, "report", True)))
    with pytest.raises(ContractError, match="several suites"):
        guards.assert_apart(good, suite((2, "report", True)))
    rows = spark.createDataFrame([(1, "train"), (2, "train"), (3, "dev")], "image_id long, split string")
    pair = lambda a, b: spark.createDataFrame([(a, b)], "image_id long, hard_id long")
    assert guards.assert_joined(pair(1, 2), rows).count() == 1
    for a, b, why in ((1, 9, "missing"), (1, 3, "outside train")):
        with pytest.raises(ContractError, match=why):
            guards.assert_joined(pair(a, b), rows)
    metrics = spark.createDataFrame([("report", 0.5)], "split string, map double")
    guards.assert_report(metrics, ("map",))
    for m, names in ((metrics.withColumn("split", F.lit("dev")), ("map",)), (metrics, ("map", "r1")), (metrics.withColumn("map", F.lit(None).cast("double")), ("map",))):
        with pytest.raises(ContractError):
            guards.assert_report(m, names)


def test_detections(spark):
    found = F.from_json(F.lit('[{"cls":0,"conf":0.9},{"cls":0,"conf":0.1},{"cls":2,"conf":0.9},{"cls":0,"conf":0.2}]'), "array<struct<cls:int,conf:double>>")
    assert [x.conf for x in spark.range(1).select(geometry.detections(found)).first()[0]] == [0.9, 0.2]


@pytest.mark.parametrize("capacity", [0, 3, 5])
def test_ring_memory_holds_the_last_rows(spark, tmp_path, capacity):
    rows = [(e, b, p, 100 * e + 10 * b + p) for e in range(2) for b in range(4) for p in range(4)]
    spark.createDataFrame(rows, "epoch long, batch long, pos long, row_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("epoch long, batch long, pos long, row_id long").parquet(str(tmp_path / "in"))
    name = f"ring{capacity}"
    jobs.rocksdb_state(spark)
    query = jobs.ring_contents(stream, capacity).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = set()
    for e, b, *_ in {r[:2] for r in rows}:
        before = sorted(r for r in rows if r[0] == e and r[1] < b)
        want |= {(e, b, r[3], b - r[1]) for r in before[len(before) - min(capacity, len(before)) :]}
    assert {tuple(r) for r in spark.table(name).collect()} == want


def test_ring_memory_goes_on_after_a_restart(spark, tmp_path):
    jobs.rocksdb_state(spark)
    rows = [(e, b, p, 100 * e + 10 * b + p) for e in range(2) for b in range(6) for p in range(b % 3 + 1)]
    schema, place = "epoch long, batch long, pos long, row_id long", {k: str(tmp_path / k) for k in ("in", "out", "cp")}
    for upto in (2, 4, 6):  # each run of the query sees two new batches, one in each micro-batch
        for b in (upto - 2, upto - 1):
            spark.createDataFrame([r for r in rows if r[1] == b], schema).coalesce(1).write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place["in"])
        jobs.ring_contents(stream, 4).writeStream.format("parquet").option("checkpointLocation", place["cp"]).trigger(availableNow=True).start(place["out"]).awaitTermination(120)
    want = set()
    for e, b in {r[:2] for r in rows}:
        before = sorted(r for r in rows if r[0] == e and r[1] < b)
        want |= {(e, b, r[3], b - r[1]) for r in before[-4:]}
    got = [tuple(r) for r in spark.read.parquet(place["out"]).collect()]
    assert len(got) == len(want) and set(got) == want
