"""Connected components of an undirected graph given as edges, by rounds of star contraction."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder in local
    mode (tests), and an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.brindle.shared", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-brindle-")
        spark.conf.set("spark.brindle.shared", path)
    return path


def saved(df: DataFrame, tidy: bool = False, **options) -> DataFrame:
    """`df` written to the shared folder, with the writer's `options`, and read back, so that a loop's lineage stays short.

    tidy: let Spark's cleaner remove the shuffle files behind the written table now, for tables that took large ones."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"brindle-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if tidy:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """`df` saved, and aggregates over it that the same job computes."""
    seen = Observation()
    out = saved(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node around it; paths
    halve, so the rounds grow with the logarithm of the longest one. Neighbour minima are aggregated before they are
    shuffled, and no task holds a node's neighbours together. Self loops keep single nodes."""
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    size = {"n": F.count(F.lit(1)), "h": F.bit_xor(F.xxhash64("a", "b"))}
    e, was = measured(edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct(), **size)
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low2 = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low2, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        new, now = measured(small.select("a", "b"), **size)
        changed = now != was
        drop_saved(e)
        e, was = new, now
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
