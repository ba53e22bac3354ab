"""Tables that one stage writes and later ones reuse: candidates, pair scores, text features, rankings, snapshots.

Each cache carries what it was made for, and a reader that asks for something else gets a ContractError instead of
numbers that don't belong together."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, caption_hash
from ..operators.guards import ContractError, assert_empty, duplicates

CANDIDATES = "brindle-candidates-1"


def _differ(a: DataFrame, b: DataFrame, message: str) -> None:
    """Raise if two tables don't hold the same rows the same number of times."""
    assert_empty(a.exceptAll(b).unionByName(b.exceptAll(a)), message)


def write_candidates(candidates: DataFrame, rows: DataFrame, path: str, split: str, k: int) -> None:
    """Save (query_id, gallery_id, score, pos) with the manifest rows (row, image_id) that they were computed for."""
    spark = candidates.sparkSession
    rows.select("row", "image_id").write.parquet(f"{path}/rows")
    candidates.select("query_id", "gallery_id", "score", "pos").write.parquet(f"{path}/candidates")
    spark.createDataFrame([(CANDIDATES, split, k)], "format string, split string, k int").coalesce(1).write.json(f"{path}/about")


def read_candidates(spark: SparkSession, path: str, split: str, rows: DataFrame) -> DataFrame:
    """The candidates in `path`, if they have the known format, are of `split`, belong to exactly these rows in this
    order, and list k different positions for each query."""
    about = spark.read.schema("format string, split string, k int").json(f"{path}/about").first()
    if about is None or about.format != CANDIDATES:
        raise ContractError(f"unknown candidate format: {about and about.format}")
    if about.split != split:
        raise ContractError(f"candidates are of split {about.split}, not {split}")
    _differ(spark.read.parquet(f"{path}/rows"), rows.select("row", "image_id"), "rows differ from those of the candidates")
    out = spark.read.parquet(f"{path}/candidates")
    shape = out.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.max("pos").alias("last"))
    assert_empty(shape.where((F.col("n") != about.k) | (F.col("places") != about.k) | (F.col("last") != about.k)), "queries without k candidates")
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """Save (query_id, gallery_id, pair_score)."""
    scores.select("query_id", "gallery_id", "pair_score").write.parquet(path)


def read_scores(spark: SparkSession, path: str, candidates: DataFrame) -> DataFrame:
    """`candidates` with the pair_score saved in `path`, which must hold just these pairs."""
    scores = spark.read.parquet(path)
    pairs = ("query_id", "gallery_id")
    _differ(scores.select(*pairs), candidates.select(*pairs), "scores don't match the candidates")
    return candidates.join(scores, list(pairs))


def write_ranking(order: DataFrame, path: str) -> None:
    """Save (query_id, pos, gallery_id) with each file's rows in order."""
    order.select("query_id", "pos", "gallery_id").repartition("query_id").sortWithinPartitions("query_id", "pos").write.parquet(path)


def with_text_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """`rows` (image_id, caption) with feature from `features` (key, feature): by image and caption, else by image alone.

    Keys of image and caption are those of cache_key(); older tables have plain image ids. A row without either raises,
    and so does a key that the table has twice, as it would double rows."""
    assert_empty(duplicates(features, "key"), "repeated keys of text features")
    f = features.select(F.col("key").alias("__k"), F.col("feature").alias("__f"))
    both = rows.withColumn("__both", cache_key(F.col("image_id"), caption_hash(F.col("caption")))).withColumn("__id", F.col("image_id").cast("string"))
    got = both.join(f, F.col("__both") == F.col("__k"), "left").drop("__k").withColumnRenamed("__f", "__f1")
    got = got.join(f, F.col("__id") == F.col("__k"), "left").withColumn("feature", F.coalesce("__f1", "__f"))
    assert_empty(got.where(F.col("feature").isNull()).select("image_id"), "rows without text features")
    return got.drop("__both", "__id", "__k", "__f", "__f1")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of the table at `path`, in order."""
    at, fs = _files(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    return sorted(int(n[len("current-") :]) for n in names if re.fullmatch("current-[0-9]+", n))


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Make `df` the table at `path`, and return its version; the last `keep` versions stay readable.

    A version is a folder of its own. It is current once its pointer, a file written under another name, is renamed: one
    step, so a reader finds either the table before or this one, whole, and a writer that breaks off leaves no trace
    in what is read. Of two writers of one version the second's rename fails."""
    spark = df.sparkSession
    at, fs = _files(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    old = _versions(spark, path)
    version = (old[-1] if old else 0) + 1
    pointer = at(f"{path}/.{name}")
    out = fs.create(pointer, True)
    out.write(name.encode())
    out.close()
    if fs.exists(at(f"{path}/current-{version}")) or not fs.rename(pointer, at(f"{path}/current-{version}")):
        raise ContractError(f"version {version} of {path} was published by another writer")
    for n in [v for v in old if v <= version - keep]:
        gone = _pointed(spark, path, n)
        fs.delete(at(f"{path}/current-{n}"), False)
        fs.delete(at(f"{path}/{gone}"), True)
    return version


def _pointed(spark: SparkSession, path: str, version: int) -> str:
    return spark.read.text(f"{path}/current-{version}").first().value


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The published table at `path`, or an earlier version of it that is still kept."""
    there = _versions(spark, path)
    if not there or (version is not None and version not in there):
        raise ContractError(f"no version {version or ''} at {path}")
    return spark.read.parquet(f"{path}/{_pointed(spark, path, version or there[-1])}")


def write_by_prefix(df: DataFrame, path: str, key: str) -> None:
    """One folder per prefix of `key` (up to its first underscore), rows of a file in numeric order of what follows."""
    parts = F.split(key, "_")
    out = df.withColumn("chunk", parts[0]).withColumn("__n", F.regexp_extract(parts[1], r"\d+", 0).cast("long"))
    out.repartition("chunk").sortWithinPartitions("chunk", "__n", key).drop("__n").write.partitionBy("chunk").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, length, content) of the files below `path`; image_id is the file name without its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("image_id"), "path", "length", "content")


def shard_digests(sharded: DataFrame, key: str, content: str) -> DataFrame:
    """(shard, n, bytes, digest) of rows with shard: SHA-256 of the lines `key:SHA-256 of the content` in key order.

    A shard has a fixed number of rows, so its lines fit a row; contents are hashed where they are and don't move."""
    lines = sharded.select("shard", F.struct(F.col(key), F.concat_ws(":", F.col(key).cast("string"), F.sha2(F.col(content), 256)).alias("line")).alias("x"), F.octet_length(content).alias("size"))
    got = lines.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list("x")).alias("all"))
    return got.select("shard", "n", "bytes", F.sha2(F.array_join(F.transform("all", lambda x: x.line), "\n").cast("binary"), 256).alias("digest"))
