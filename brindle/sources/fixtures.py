"""Domain tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

DIM = 64


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gallery_id, label, vec."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gallery_id"), "label", F.col("embedding").alias("vec"))


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, gt_id, label, vec: every fifth vector, mixed with two others by a weight that cycles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    n = e.agg(F.count("*").alias("n"))
    q = e.where("vec_id % 5 = 0").crossJoin(F.broadcast(n))  # one row
    q = q.withColumn("w", F.get(F.array(*[F.lit(x) for x in (0.6, 1.2, 1.8, 2.4)]), F.floor(F.col("vec_id") / 5).cast("int") % 4))
    q = q.withColumn("near_id", F.floor(F.col("vec_id") / 25) * 25 + 1).withColumn("far_id", (F.col("vec_id") * 37 + 11) % F.col("n"))
    a = e.select(F.col("vec_id").alias("near_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("far_id"), F.col("embedding").alias("b"))
    mixed = F.expr("transform(sequence(0, 63), i -> cast((cast(embedding[i] as double) + w * cast(a[i] as double)) + (0.8D * w) * cast(b[i] as double) as float))")
    return q.join(a, "near_id").join(b, "far_id").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("gt_id"), "label", mixed.alias("vec"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as an image with a caption, a hard target and its bucket."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = d.agg(F.count("*").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    bucket = F.get(F.array(F.lit("goal"), F.lit("full"), F.lit("wentwrong")), (F.col("doc_id") % 3).cast("int"))
    rows = d.crossJoin(F.broadcast(n)).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"),
        F.when(F.col("doc_id") % 20 == 0, (F.col("doc_id") + 4) % F.col("n")).otherwise(F.col("doc_id").bitwiseXOR(F.lit(1).cast("long"))).alias("hard_id"),
        F.floor(F.col("doc_id") / 4).alias("video_id"),
        F.col("text").alias("caption"),
        bucket.alias("bucket"),
        F.when(F.col("toxic") == 1, "anomaly").otherwise("normal").alias("label_type"),
        F.col("source").alias("label"),
        F.col("lang").alias("action"),
        (F.col("doc_id") % 7).alias("scene"),
        F.concat(F.lit("train/imgs_"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit("/"), bucket, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
    )
    target = d.select(F.col("doc_id").alias("hard_id"), F.col("text").alias("hard_c"))
    return rows.join(target, "hard_id", "left").select("image_id", "hard_id", "video_id", "caption", "hard_c", "bucket", "label_type", "label", "action", "scene", "image")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, original, raw, label_type: captions with a simulated generator's output."""
    a = annotations(spark, sf_dir).select("image_id", F.col("caption").alias("original"), "label_type")
    k, t = F.col("image_id") % 6, F.col("original")
    raw = (
        F.when(k == 0, t).when(k == 1, F.concat(F.lit("Caption: "), t)).when(k == 2, F.concat(F.lit("**"), t, F.lit("**")))
        .when(k == 3, t.substr(F.lit(1), F.floor(F.char_length(t) / 2).cast("int"))).when(k == 4, F.lit("")).otherwise(F.concat(F.lit('"'), t, F.lit('"')))
    )
    return a.withColumn("raw", raw)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, line, x1, y1, x2, y2, score: detector boxes within the unit square."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    x1, y1 = (F.col("l_quantity") - 1) / 100, F.col("l_discount") * 5
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"),
        clip(x1).alias("x1"), clip(y1).alias("y1"), clip(x1 + 0.02 + F.col("l_tax") * 5).alias("x2"), clip(y1 + 0.4).alias("y2"),
        (F.col("l_extendedprice") / 105000).alias("score"),
    )


def sequence_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A training sequence (event_id, batch, epoch, pos, instance, caption, img, txt) whose img and txt are ids, and the vectors
    (vec_id, vec) that they name."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = e.agg(F.count("*").alias("n"))
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").crossJoin(F.broadcast(n))
    keys = ev.select(
        "event_id", F.floor(F.col("event_id") / 32).alias("batch"), F.floor(F.col("event_id") / 2560).alias("epoch"), (F.col("event_id") % 32).alias("pos"),
        F.col("user_id").alias("instance"), F.col("event_type").alias("caption"),
        (F.col("event_id") % F.col("n")).alias("img"), ((F.col("event_id") * 7 + 3) % F.col("n")).alias("txt"),
    )
    return keys, e


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, batch, epoch, pos, instance, caption, img, txt: a training sequence with two vectors a row."""
    keys, e = sequence_keys(spark, sf_dir)
    keys = keys.withColumnsRenamed({"img": "i", "txt": "t"})
    return keys.join(e.select(F.col("vec_id").alias("i"), F.col("vec").alias("img")), "i").join(e.select(F.col("vec_id").alias("t"), F.col("vec").alias("txt")), "t").drop("i", "t")
