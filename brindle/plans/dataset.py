"""Dataset queries: splits, sampling, suites, manifest, caption tasks and boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import batching, sampling, splits
from ..operators.components import drop_saved, saved, shared_dir
from ..operators.guards import assert_suite, duplicates, missing
from ..operators.ordering import first_rows, numbered, segmented
from ..sources import fixtures, tables

SEED = 2026
SIZES = [20, 40, 80]


def _ann(spark, sf_dir):
    return fixtures.annotations(spark, sf_dir)


def _components(a):
    """Components of the videos of `a`. Rows without a target are a reject reason here, as in the SQL, not an error."""
    return splits.video_components(a, strict=False)


def _split_of(spark, sf_dir):
    a = _ann(spark, sf_dir)
    c = _components(a)
    dealt = splits.deal(splits.component_sizes(a, c), seed=SEED)
    return saved(splits.by_video(c, dealt))


def _with_split(spark, sf_dir, split=None):
    """Annotations with their split; `split` is the saved table of _split_of(), where a query needs it more than once."""
    return _ann(spark, sf_dir).join(split or _split_of(spark, sf_dir), "video_id")


def _pairs(spark, sf_dir, split=None):
    """Annotations with their hard target's columns."""
    a = _with_split(spark, sf_dir, split)
    t = a.select(F.col("image_id").alias("hard_id"), F.col("split").alias("hard_split"), F.col("bucket").alias("hard_bucket"), F.col("video_id").alias("hard_video"), F.col("action").alias("hard_action"), F.col("scene").alias("hard_scene"))
    return a.join(t, "hard_id", "left")


# ---------------------------------------------------------------- splits


def components(spark, sf_dir):
    return _components(_ann(spark, sf_dir))


def component_sizes(spark, sf_dir):
    a = _ann(spark, sf_dir)
    return splits.component_sizes(a, _components(a))


def split_assign(spark, sf_dir):
    a = _ann(spark, sf_dir)
    return splits.deal(splits.component_sizes(a, _components(a)), seed=SEED)


def split_summary(spark, sf_dir):
    a = _ann(spark, sf_dir)
    c = _components(a)
    sizes = splits.component_sizes(a, c)
    d = splits.deal(sizes, seed=SEED).join(sizes.select("component", "n_videos"), "component")
    w = Window.partitionBy()
    out = d.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_videos").alias("n_videos"), F.count("*").alias("n_components"), F.max("n_rows").alias("largest"))
    return out.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(w), 6))


def split_leakage(spark, sf_dir):
    a = _ann(spark, sf_dir)
    return splits.leakage(a, _split_of(spark, sf_dir)).agg(F.count("*").alias("leaks"))


def ordered_components(spark, sf_dir):
    a = _ann(spark, sf_dir)
    o = splits.ordered(splits.component_sizes(a, _components(a)), SEED).withColumn("neg", -F.col("n_rows"))
    return numbered(o, ["neg", "key", "component"]).select("component", "n_rows", F.col("rn").alias("place"))


# ---------------------------------------------------------------- sampling


def quota_apportion(spark, sf_dir):
    """Quotas of subsets as large as each label, and of sizes that each chunk of 97 rows gives."""
    a = _ann(spark, sf_dir)
    labels = a.groupBy("label").agg(F.count("*").alias("n")).select(F.coalesce("label", F.lit("")).alias("of"), "n")
    chunks = a.groupBy(F.floor(F.col("image_id") / 97).cast("string").alias("of")).agg((F.count("*") * 7 + F.min("image_id") % 11).alias("n"))
    return sampling.quota_table(labels.unionByName(chunks))


def reject_reasons(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("reason", sampling.reject_reason()).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def reject_cases(spark, sf_dir):
    """Reject reasons where some pairs lack a target, some captions are blank and some pairs share their text."""
    p = _pairs(spark, sf_dir).withColumn("hard_split", F.when(F.col("image_id") % 13 != 0, F.col("hard_split"))).withColumn("caption", F.when(F.col("image_id") % 11 == 0, " \t ").otherwise(F.col("caption")))
    p = p.withColumn("hard_c", F.when(F.col("image_id") % 7 == 0, F.concat(F.lit("  "), "caption")).otherwise(F.col("hard_c")))
    return p.groupBy("bucket", F.coalesce(sampling.reject_reason(), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def _candidate_order(p):
    """`p` with ord: within a bucket harder pairs first, then rarer labels, then by stable hash."""
    labels = p.groupBy("bucket", "label").agg(F.count("*").alias("of_label"))
    p = p.join(labels, ["bucket", "label"]).withColumn("less", -F.col("hardness")).withColumn("h", text.stable_key(SEED, "train", "order", F.col("image_id")))
    return segmented(p, ["bucket"], ["less", "of_label", "h", "image_id"], "ord").drop("less", "h", "of_label")


def hard_score_order(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("hardness", sampling.pair_score()).select("image_id", "bucket", "label", "hardness")
    return _candidate_order(p).select("image_id", "bucket", "hardness", F.col("ord").cast("int").alias("ord"))


def rare_label_boost(spark, sf_dir):
    a = _ann(spark, sf_dir).select("bucket", "label").withColumn("rarity", sampling.rarity())
    return a.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.round(F.max("rarity"), 6).alias("rarity"))


def _queries(spark, sf_dir):
    dev = saved(_with_split(spark, sf_dir).where("split = 'dev'"))
    return dev, saved(sampling.pick_queries(dev, sampling.quotas(20), SEED, "dev"))


def eval_queries(spark, sf_dir):
    return _queries(spark, sf_dir)[1].select("image_id", "bucket", "h")


def _suite(spark, sf_dir):
    """The saved dev suite (image_id, bucket, split, is_query), after its contract is checked."""
    dev, q = _queries(spark, sf_dir)
    fill = sampling.fill_gallery(dev, q, sampling.quotas(40), SEED, "dev")
    rows = q.select("image_id", "bucket", "split", F.lit(True).alias("is_query")).unionByName(fill.select("image_id", "bucket", "split", F.lit(False).alias("is_query")))
    suite = saved(rows)
    assert_suite(suite, "dev")
    drop_saved(dev, q)
    return suite


def eval_gallery(spark, sf_dir):
    return _suite(spark, sf_dir).select("image_id", "bucket", "is_query")


def gallery_pool(spark, sf_dir):
    dev, q = _queries(spark, sf_dir)
    return dev.join(q.select("image_id"), "image_id", "left_anti").groupBy("bucket").agg(F.count("*").alias("n"))


def suite_sorted(spark, sf_dir):
    return numbered(eval_gallery(spark, sf_dir), "image_id").select(F.col("rn").alias("place"), "image_id", "is_query")


def stable_hash_order(spark, sf_dir):
    a = _ann(spark, sf_dir).select("image_id", "bucket", text.stable_key(SEED, "train", "pick", F.col("image_id")).alias("h"))
    w = Window.partitionBy("bucket").orderBy("h", "image_id")
    return a.withColumn("place", F.row_number().over(w)).where("place <= 10")


def nested_subset(spark, sf_dir):
    p = _pairs(spark, sf_dir).where(sampling.reject_reason().isNull()).withColumn("hardness", sampling.pair_score())
    o = _candidate_order(p).select("image_id", "bucket", "ord", text.text_key(F.col("caption")).alias("key"), text.text_key(F.col("hard_c")).alias("hard_key"))
    return sampling.nested_subsets(o, SIZES)


def _selected(spark, sf_dir, split=None):
    """Anchors for the manifest: all eligible pairs."""
    return _pairs(spark, sf_dir, split).where(sampling.reject_reason().isNull())


def hard_edges(spark, sf_dir):
    """Edges with both ends eligible."""
    p = _pairs(spark, sf_dir).where(sampling.reject_reason().isNull())
    c = F.col
    tags = text.edge_relation(c("video_id"), c("hard_video"), c("bucket"), c("hard_bucket"), c("action"), c("hard_action"), c("scene"), c("hard_scene"))
    both = p.join(p.select(F.col("image_id").alias("hard_id")), "hard_id", "left_semi")
    return both.select(F.concat_ws("->", "image_id", "hard_id").alias("edge_id"), "image_id", "hard_id", "bucket", "hard_bucket", "video_id", F.array_join(tags, ",").alias("relation"))


def edge_degree(spark, sf_dir):
    e = hard_edges(spark, sf_dir)
    return e.select("image_id").unionByName(e.select(F.col("hard_id").alias("image_id"))).groupBy("image_id").agg(F.count("*").alias("degree"))


# ---------------------------------------------------------------- manifest


def _manifest_train(spark, sf_dir, split=None):
    split = split or _split_of(spark, sf_dir)
    anchors = _selected(spark, sf_dir, split)
    every = _with_split(spark, sf_dir, split)
    targets = every.join(anchors.select(F.col("hard_id").alias("image_id")).distinct(), "image_id", "left_semi").join(anchors.select("image_id"), "image_id", "left_anti")
    a = anchors.select("image_id", F.col("hard_id").alias("pair_image_id"), "caption", "video_id", "bucket", "label", "label_type", "scene", "action", "split", F.lit(False).alias("is_hard_target"), "image")
    t = targets.select("image_id", F.lit(None).cast("long").alias("pair_image_id"), "caption", "video_id", "bucket", "label", "label_type", "scene", "action", "split", F.lit(True).alias("is_hard_target"), "image")
    return a.unionByName(t)


def _finish(m):
    return m.select("image_id", F.coalesce("pair_image_id", F.lit(-1)).alias("pair_image_id"), text.webp_path(F.col("image"), "images/").alias("image_path"), text.caption(F.lit(None).cast("string"), F.col("caption")).alias("caption"), F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit("_"), "bucket").alias("sequence_id"), "label", "label_type", "bucket", "scene", "action", "split", "is_hard_target")


def manifest_train(spark, sf_dir):
    return _finish(_manifest_train(spark, sf_dir))


def _manifest_all(spark, sf_dir):
    split = _split_of(spark, sf_dir)
    held = _with_split(spark, sf_dir, split).where("split <> 'train'").select("image_id", F.lit(None).cast("long").alias("pair_image_id"), "caption", "video_id", "bucket", "label", "label_type", "scene", "action", "split", F.lit(False).alias("is_hard_target"), "image")
    return _manifest_train(spark, sf_dir, split).unionByName(held, allowMissingColumns=True)


def manifest_all(spark, sf_dir):
    return _manifest_all(spark, sf_dir).groupBy("split", "is_hard_target", "bucket").agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"))


def eval_caption_demote(spark, sf_dir):
    m = _manifest_all(spark, sf_dir).where("split <> 'train'").withColumn("key", text.text_key("caption"))
    again = F.row_number().over(Window.partitionBy("split", "key").orderBy("image_id")) > 1
    return m.select("image_id", "split", F.when(again, "").otherwise(F.col("key")).alias("key"), again.alias("demoted"))


def manifest_joins(spark, sf_dir):
    m = _manifest_train(spark, sf_dir).select("image_id", "split", "is_hard_target")
    b = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("n_boxes"), F.round(F.max(F.col("l_extendedprice") / 105000), 6).alias("best"))
    return m.join(b, "image_id", "left").select("image_id", "split", "is_hard_target", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce("best", F.lit(0.0)).alias("best"), F.when(F.col("n_boxes").isNull(), "missing").otherwise("ok").alias("bbox_status"))


def pair_index(spark, sf_dir):
    m = numbered(_manifest_train(spark, sf_dir).select("image_id", "pair_image_id", "video_id"), "image_id").withColumn("row", F.col("rn") - 1)
    p = m.select(F.col("image_id").alias("pair_image_id"), F.col("row").alias("partner"))
    return m.join(p, "pair_image_id").where("row <> partner").select("row", "partner", "video_id")


def label_counts(spark, sf_dir):
    return _ann(spark, sf_dir).groupBy("bucket", "label_type", "action").agg(F.count("*").alias("n"))


def label_counts_topn(spark, sf_dir):
    return _ann(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(20)


def caption_distinct(spark, sf_dir):
    k = _ann(spark, sf_dir).select("bucket", text.text_key(F.col("caption")).alias("key"))
    return k.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("key").alias("distinct_keys")).withColumn("surplus", F.col("n") - F.col("distinct_keys"))


def dup_id_guard(spark, sf_dir):
    a = _ann(spark, sf_dir).select("image_id")
    return duplicates(a.unionByName(a.where("image_id % 97 = 0")), "image_id")


def missing_id_guard(spark, sf_dir):
    a = _ann(spark, sf_dir).select("image_id")
    n = a.agg(F.max("image_id").alias("m"))
    wanted = a.unionByName(a.where("image_id % 50 = 0").crossJoin(F.broadcast(n)).select((F.col("image_id") + F.col("m") + 1).alias("image_id")))
    return missing(wanted, a, "image_id")


def instance_codes(spark, sf_dir):
    a = _ann(spark, sf_dir).select("image_id", "label")
    codes = numbered(a.select("label").distinct(), "label").select("label", (F.col("rn") - 1).cast("int").alias("code"))
    return a.join(codes, "label").select("image_id", "label", "code")


def first_occurrence_dedupe(spark, sf_dir):
    a = _ann(spark, sf_dir).select("image_id", text.text_key(F.col("caption")).alias("key"))
    return first_rows(a, ["key"], ["image_id"]).select("image_id")


def chunk_partition(spark, sf_dir):
    a = _ann(spark, sf_dir).select(F.concat(F.floor(F.col("image_id") / 50).cast("string"), F.lit("_"), F.col("image_id").cast("string")).alias("id"))
    return a.groupBy(F.split("id", "_")[0].cast("int").alias("chunk")).agg(F.count("*").alias("n"))


def table_fingerprint(spark, sf_dir):
    return tables.fingerprint(_ann(spark, sf_dir))


def shard_sizes(spark, sf_dir):
    return tables.shards(_ann(spark, sf_dir).select("image_id"), "image_id", 128).groupBy("shard").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id"), F.max("image_id").alias("last_id"))


def stride_sample(spark, sf_dir):
    a = numbered(_ann(spark, sf_dir).select("image_id"), "image_id")
    n = a.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 64)).alias("stride"))
    return a.crossJoin(F.broadcast(n)).where(((F.col("rn") - 1) % F.col("stride") == 0) & ((F.col("rn") - 1) / F.col("stride") < 64)).select("image_id")


def asset_union(spark, sf_dir):
    a = _ann(spark, sf_dir)
    names = _ann(spark, sf_dir).select(F.col("image_id").alias("hard_id"), F.col("image").alias("hard_image"))
    both = a.select(F.col("image").alias("path"), "image_id", F.lit("anchor").alias("role")).unionByName(a.join(names, "hard_id").select(F.col("hard_image").alias("path"), F.col("hard_id").alias("image_id"), F.lit("target").alias("role")))
    return both.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.min("image_id").alias("image_id"))


# ---------------------------------------------------------------- text


def text_key(spark, sf_dir):
    return _ann(spark, sf_dir).select("image_id", F.md5(text.text_key(F.col("caption")).cast("binary")).alias("key_md5"))


def caption_hash(spark, sf_dir):
    return _ann(spark, sf_dir).select("image_id", text.caption_hash(F.col("caption")).alias("hash"))


def long_caption_rate(spark, sf_dir):
    n = F.size(F.filter(F.split("caption", r"\s+"), lambda w: w != ""))
    return _ann(spark, sf_dir).groupBy("bucket").agg(F.round(F.avg((n > 72).cast("double")), 6).alias("rate"))


def label_bucket_path(spark, sf_dir):
    a = _ann(spark, sf_dir)
    info = text.label_info(F.when(F.col("label_type") == "anomaly", F.col("label")), F.when(F.col("image_id") % 3 != 0, F.col("label")))
    return a.select("image_id", info.label_type.alias("label_type"), info.label.alias("label"), text.bucket_of_path(F.col("image")).alias("bucket"), text.webp_path(F.regexp_replace("image", "/", "\\\\"), "root/").alias("path"), F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit("_"), "bucket").alias("sequence_id"))


def path_rules(spark, sf_dir):
    """Source and output places of image names in each of the forms that annotations use."""
    name = F.col("image_id").cast("string")
    forms = ["data/train_webp/a/", "train_webp/b\\", "imgs_3/full/", "train/imgs_1/goal/", "/abs/x/train_webp/c/", "other/d/"]
    path = F.coalesce(*[F.when(F.col("image_id") % len(forms) == k, F.concat(F.lit(f), name, F.lit(".jpg"))) for k, f in enumerate(forms)])
    return _ann(spark, sf_dir).select("image_id", text.source_path(path, "/root/data", "/img").alias("source"), text.output_path(path).alias("output"))


def caption_coalesce(spark, sf_dir):
    enhanced = F.when(F.col("image_id") % 3 == 0, "  ").when(F.col("image_id") % 3 == 1, F.concat(F.lit(" x"), F.col("image_id").cast("string")))
    return _ann(spark, sf_dir).select("image_id", F.md5(text.caption(enhanced, F.col("caption")).cast("binary")).alias("caption_md5"))


def manifest_scan(spark, sf_dir):
    """The report split of a manifest that is written in a folder per split: the others' files aren't opened."""
    path = f"{shared_dir(spark)}/brindle-manifest-{uuid.uuid4().hex}"
    tables.write_manifest(_with_split(spark, sf_dir).select("image_id", "video_id", "split"), path)
    return tables.read_manifest(spark, path, "report")


def split_filter(spark, sf_dir):
    return _with_split(spark, sf_dir).where("split = 'report'").select("image_id", "video_id", "split")


def query_filter(spark, sf_dir):
    c = F.when(F.col("image_id") % 5 == 0, "   ").when(F.col("image_id") % 7 == 0, F.lit(None)).otherwise(F.col("caption"))
    return _ann(spark, sf_dir).withColumn("c", c).where(F.trim(F.coalesce("c", F.lit(""))) != "").select("image_id")


def cache_and_task_keys(spark, sf_dir):
    a = _ann(spark, sf_dir)
    doc = F.concat(F.lit('{"field":"caption","row":'), F.col("image_id").cast("string"), F.lit(',"type":"'), "label_type", F.lit('"}'))
    return a.select("image_id", text.cache_key(F.col("image_id"), text.caption_hash(F.col("caption"))).alias("cache_key"), F.sha2(doc.cast("binary"), 256).alias("task_key"))


def _tasks(spark, sf_dir):
    """image_id, field, original, label_type: captions and hard captions to be rewritten."""
    a = _ann(spark, sf_dir)
    two = F.explode(F.array(F.struct(F.lit("caption").alias("field"), F.col("caption").alias("original")), F.struct(F.lit("hard_c").alias("field"), F.col("hard_c").alias("original")))).alias("t")
    t = a.select("image_id", "label_type", "label", "action", two).select("image_id", "label_type", "label", "action", "t.*")
    return t.where((F.coalesce("label", F.lit("")) != "") & (F.trim(F.coalesce("original", F.lit(""))) != "") & ~((F.col("field") == "hard_c") & (F.col("image_id") % 4 == 0)))


def caption_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).select("image_id", "field", "label_type", F.char_length("original").alias("n"))


def selected_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).where("label_type = 'anomaly'").select("image_id", "field")


def limited_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).select("image_id", "field").orderBy("image_id", "field").limit(25)


def prompt_render(spark, sf_dir):
    return _tasks(spark, sf_dir).select("image_id", "field", F.md5(text.prompt(F.col("label_type"), F.col("action"), F.col("label"), F.col("original")).cast("binary")).alias("prompt_md5"))


def caption_gate(spark, sf_dir):
    g = fixtures.generated(spark, sf_dir)
    out = text.finalize(F.col("original"), F.col("raw"), F.col("label_type"))
    clean = text.clean_generation(F.col("raw"))
    return g.select("image_id", text.n_tokens(F.col("raw")).alias("n_tokens"), text.output_is_bad(F.col("original"), clean).alias("bad"), F.md5(clean.cast("binary")).alias("clean_md5"), F.md5(out.cast("binary")).alias("final_md5"))


def _progress(spark, sf_dir):
    """seq, image_id, output: two records for every tenth task."""
    d = _ann(spark, sf_dir).where("image_id % 10 = 0").select("image_id")
    return d.select("image_id", F.explode(F.array(F.struct((F.col("image_id") * 2).alias("seq"), F.lit("first").alias("output")), F.struct((F.col("image_id") * 2 + 1).alias("seq"), F.lit("second").alias("output")))).alias("x")).select("image_id", "x.*")


def progress_replay(spark, sf_dir):
    last = _progress(spark, sf_dir).groupBy("image_id").agg(F.max_by("output", "seq").alias("output"))
    return _ann(spark, sf_dir).select("image_id").join(last, "image_id", "left").select("image_id", F.coalesce("output", F.lit("pending")).alias("state"))


def tokenizer(spark, sf_dir):
    ids = _ann(spark, sf_dir).select("image_id", text.tokenize(F.col("caption")).alias("ids"))
    return ids.select("image_id", F.array_join("ids", " ").alias("ids"), F.array_join(text.attention_mask(F.col("ids")), "").alias("mask"))


# ---------------------------------------------------------------- boxes


def _boxes(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir).where("score >= 0.2")
    box = F.array("x1", "y1", "x2", "y2")
    return b.withColumn("area", geometry.area(box)).withColumn("weight", F.col("score") * F.greatest("area", F.lit(1e-8)))


def box_primary_union(spark, sf_dir):
    """Primary box by weight, and the union box unless it covers more than 0.85 of the image."""
    order = F.struct("weight", *[(-F.col(c)).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])
    agg = _boxes(spark, sf_dir).groupBy("image_id").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), order).alias("p"), F.min("x1").alias("u1"), F.min("y1").alias("u2"), F.max("x2").alias("u3"), F.max("y2").alias("u4"), F.count("*").alias("n"))
    wide = (F.col("u3") - F.col("u1")) * (F.col("u4") - F.col("u2")) > 0.85
    use = lambda u, p: F.round(F.when(wide, F.col(p)).otherwise(F.col(u)), 6)
    return agg.select("image_id", "n", *[F.round(f"p.{c}", 6).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")], use("u1", "p.x1").alias("u_x1"), use("u2", "p.y1").alias("u_y1"), use("u3", "p.x2").alias("u_x2"), use("u4", "p.y2").alias("u_y2"))


def _status(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    n = _boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"))
    return orders.join(n, "image_id", "left").select("image_id", F.when(F.col("n").isNull(), "no_person").otherwise("ok").alias("status"))


def box_coverage(spark, sf_dir):
    return _status(spark, sf_dir).agg(F.count("*").alias("total"), F.round(F.avg((F.col("status") == "ok").cast("double")), 6).alias("coverage"), (F.avg((F.col("status") == "ok").cast("double")) < 0.97).alias("warn"))


def pending_assets(spark, sf_dir):
    done = _boxes(spark, sf_dir).where("image_id % 3 = 0").select("image_id").distinct()
    return _status(spark, sf_dir).select("image_id").join(done, "image_id", "left_anti")


def fallback_assets(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return orders.join(_status(spark, sf_dir).where("status = 'no_person'").select("image_id"), "image_id", "left_semi")


def _box_rows(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir)
    return b.select("image_id", "line", F.array("x1", "y1", "x2", "y2").alias("box")).distinct()


def _four(x, name):
    return [F.round(F.get(x, F.lit(k)), 6).alias(f"{name}{k}") for k in range(4)]


def bbox_xywh(spark, sf_dir):
    return _box_rows(spark, sf_dir).select("image_id", "line", geometry.xyxy_to_xywh(F.col("box")).alias("b")).select("image_id", "line", *_four(F.col("b"), "b"))


def bbox_expand(spark, sf_dir):
    return _box_rows(spark, sf_dir).select("image_id", "line", geometry.expand_xywh(geometry.xyxy_to_xywh(F.col("box"))).alias("b")).select("image_id", "line", *_four(F.col("b"), "b"))


def box_normalise(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey").distinct()
    q = F.col("l_quantity")
    b = geometry.normalize_box(q - 10, q, q * 3, q * 5, F.lit(100), F.when(F.col("l_suppkey") % 2 == 0, F.lit(0)).otherwise(F.lit(200)))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", b.alias("b")).select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", *_four(F.col("b"), "b"), F.round(geometry.area(F.col("b")), 6).alias("area"))


def parse_list_cell(spark, sf_dir):
    """Boxes from cells of text: of four numbers, of two, absent and blank ones."""
    e = tables.table(spark, sf_dir, "embeddings")
    k = [F.floor(F.get("embedding", F.lit(i)).cast("double") * 1000).cast("string") for i in range(4)]
    four = F.concat(F.lit("["), F.concat_ws(", ", k[0], F.concat(k[1], F.lit(".5")), k[2], k[3]), F.lit("]"))
    cell = F.when(F.col("vec_id") % 5 == 1, F.concat(F.lit("["), F.concat_ws(", ", *k[:2]), F.lit("]"))).when(F.col("vec_id") % 5 == 2, F.lit(None)).when(F.col("vec_id") % 5 == 3, "").otherwise(four)
    b = geometry.parse_list(cell, 4)
    return e.select("vec_id", b[0].alias("a"), b[3].alias("d"))


def keypoints_flat(spark, sf_dir):
    """Seventeen points (x, y, c) of each vector, flattened; rows without a good status or with too few points have none."""
    e = tables.table(spark, sf_dir, "embeddings")
    points = F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 7 == 5, 15).otherwise(16)), lambda k: F.array(*[F.get("embedding", 3 * k + i).cast("double") for i in range(3)]))
    flat = geometry.flat_keypoints(F.when(F.col("vec_id") % 5 == 4, "bad").otherwise("ok"), points, F.when(F.col("vec_id") % 3 == 0, F.lit(0)).otherwise(F.lit(100)), F.lit(50))
    rows = e.select("vec_id", flat.alias("flat"))
    return rows.select("vec_id", F.coalesce(F.size("flat"), F.lit(-1)).alias("n"), F.round(F.aggregate("flat", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# ---------------------------------------------------------------- batches


def _row_pairs(spark, sf_dir):
    return _selected(spark, sf_dir).select(F.col("image_id").alias("a"), F.col("hard_id").alias("b"), F.col("video_id").alias("grp"))


def pair_batches(spark, sf_dir):
    return batching.pair_batches(_row_pairs(spark, sf_dir), 16, 0, SEED)


def partner_index(spark, sf_dir):
    return batching.unpaired(pair_batches(spark, sf_dir))


def itm_pairs_explicit(spark, sf_dir):
    return batching.match_pairs(partner_index(spark, sf_dir), ["batch"])


def epoch_reshuffle(spark, sf_dir):
    return batching.pair_batches(_row_pairs(spark, sf_dir), 16, 1, SEED).select("epoch", "batch", "slot", "a")


def mixed_batches(spark, sf_dir):
    rows = _ann(spark, sf_dir).select(F.col("image_id").alias("row_id"))
    return batching.mixed_batches(_row_pairs(spark, sf_dir), rows, 16, 4, 0, SEED)


def grouped_batches(spark, sf_dir):
    rows = _ann(spark, sf_dir).select(F.col("image_id").alias("row_id"), F.col("label").alias("grp"))
    return batching.grouped_batches(rows, 16, 0.5, 0, SEED)


def augment_spec(spark, sf_dir):
    rows = _ann(spark, sf_dir).select(F.col("image_id").alias("row_id"))
    return batching.augment_spec(rows, {"blur": 0.3, "jpeg": 0.3, "scale": 0.2, "jitter": 0.4, "noise": 0.2, "erase": 0.25}, 2, SEED)


QUERIES = [
    components, component_sizes, split_assign, split_summary, split_leakage, ordered_components, quota_apportion, reject_reasons, reject_cases, hard_score_order, rare_label_boost,
    eval_queries, eval_gallery, gallery_pool, suite_sorted, stable_hash_order, nested_subset, hard_edges, edge_degree, manifest_train, manifest_all, eval_caption_demote,
    manifest_joins, pair_index, label_counts, label_counts_topn, caption_distinct, dup_id_guard, missing_id_guard, instance_codes, first_occurrence_dedupe, chunk_partition,
    table_fingerprint, shard_sizes, stride_sample, asset_union, text_key, caption_hash, long_caption_rate, label_bucket_path, path_rules, caption_coalesce, manifest_scan, split_filter, query_filter,
    cache_and_task_keys, caption_tasks, selected_tasks, limited_tasks, prompt_render, caption_gate, progress_replay, tokenizer, box_primary_union, box_coverage,
    pending_assets, fallback_assets, bbox_xywh, bbox_expand, box_normalise, parse_list_cell, keypoints_flat, pair_batches, partner_index, itm_pairs_explicit,
    epoch_reshuffle, mixed_batches, grouped_batches, augment_spec,
]
