"""Tables in and out: annotation JSON lines, keyed JSON documents, manifests, logs and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.guards import ContractError

ANNOTATION = "image_id string, hard_i_id string, video_id long, image string, hard_i string, caption string, hard_c string, anomaly string, normal string, action string, scene string, source_caption string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_annotations(spark: SparkSession, glob: str, schema: str = ANNOTATION) -> DataFrame:
    """JSON lines of all matching files with their numeric file order; blank lines are skipped, malformed ones fail."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(glob)
    return rows.withColumn("file_no", F.regexp_extract(F.input_file_name(), r"(\d+)\.jsonl?$", 1).cast("int"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files, blank ones included in the count; lines count from 1.

    A file is read in splits. A line's number is its place in its split plus the lines of the splits before it, which
    are counted in a row per split, so no task reads a file whole."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    size = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = size.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("i") + F.col("shift")).alias("line"), "value")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON line logs with file and line. Blank lines are skipped; a malformed one raises an error that names
    file and line of the first."""
    full = f"{schema}, __bad string"
    rows = read_lines(spark, path).where(F.trim("value") != "").withColumn("x", F.from_json("value", full, {"columnNameOfCorruptRecord": "__bad"}))
    bad = rows.where(F.col("x").isNull() | F.col("x.__bad").isNotNull() | ~F.trim("value").startswith("{")).select("file", "line").orderBy("file", "line").limit(1).collect()
    if bad:
        raise ContractError(f"malformed record in {bad[0].file}, line {bad[0].line}")
    return rows.select("file", "line", "x.*").drop("__bad")


def last_records(log: DataFrame, *keys: str) -> DataFrame:
    """The last record of each key of a log read by read_log(), in the order of file and line."""
    rest = [c for c in log.columns if c not in (*keys, "file", "line")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def read_items(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Rows of a JSON document whose `items` is a list of objects or an object keyed by image id. `value`: fields as DDL."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json(F.get_json_object("value", "$.items"), f"array<struct<image_id:string,{value}>>")
    as_map = F.from_json(F.get_json_object("value", "$.items"), f"map<string,struct<image_id:string,{value}>>")
    is_list = F.get_json_object("value", "$.items").startswith("[")
    listed = text.where(is_list).select(F.explode(as_list).alias("x")).select("x.*")
    keyed = text.where(~is_list).select(F.explode(as_map).alias("k", "x")).select(F.coalesce("x.image_id", "k").alias("image_id"), *[f"x.{c.split(':')[0].strip()}" for c in value.split(",")])
    return listed.unionByName(keyed)


def write_manifest(df: DataFrame, path: str) -> None:
    """Parquet, one folder per split, so that a split predicate prunes files."""
    df.write.partitionBy("split").parquet(path)


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (progress and metric logs)."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A CSV table with header."""
    df.write.option("header", True).csv(path)


def latex(df: DataFrame) -> DataFrame:
    """(line) of a LaTeX table body: cells joined by &, rows ended by a double backslash."""
    return df.select(F.concat(F.concat_ws(" & ", *df.columns), F.lit(r" \\")).alias("line"))


def shards(df: DataFrame, key: str, size: int, partitions: int | None = None) -> DataFrame:
    """`df` with shard = position // size in key order.

    Positions come from ranges of the key: a count per range, then numbers within it, so no task sees all rows."""
    from ..operators.ordering import numbered

    return numbered(df, key, partitions).withColumn("shard", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, first, second): row count, and the sums modulo 2^60 of two parts of each row's SHA-256.

    Independent of order and partitioning; as sums, unlike exclusive ors, count how often a row occurs. A row is its columns
    as text in the order of their names, joined by unit separators, a null as a record separator."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(df.columns)])
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    total = lambda at: F.coalesce(F.sum(part(at)) % (1 << 60), F.lit(0)).cast("long")
    return df.select(F.sha2(text.cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"), total(1).alias("first"), total(16).alias("second"))
