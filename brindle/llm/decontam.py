"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items fall into size classes by their number of distinct five-word shingles, doubling from class to class. An item's
sketch is its bottom-k MinHash, the k smallest shingle hashes, where k is what the largest size of its class needs:
k = m - ceil(t * m) + 1 for containment t and size m. A document that holds the share t of an item of n shingles
misses n - ceil(t * n) of them at most, so it holds all but so many of the sketch's hashes, and one at least. The
search loses nothing, however long the document is. (Banded signatures of whole documents can't do that: forty
shingles within five thousand have a Jaccard similarity below 0.01.)

Only sketches are searched for in all documents. The full shingles of an item are compared with those of a document
only where the search has found the two, which verifies the pair exactly.

Only DataFrame functions are used. Documents are never shuffled: their shingles meet sketches in a broadcast join
when those are known to be few, and only matches move on, counted before they are shuffled. Beyond that bound the join
shuffles by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, fits_broadcast, fresh
from .native import shingle_hashes, word_list

#: Most item shingles, and documents that a search has found, that are broadcast (about 60 MB).
BROADCAST_ROWS = 2_000_000


def _share(n: Column, threshold: float) -> Column:
    """The least number of an item's n shingles that a document must hold."""
    return F.ceil(F.round(F.lit(threshold) * n, 9)).cast("int")


def item_shingles(items: DataFrame, threshold: float = 0.8, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, h, n_item, size_class, need, in_sketch): distinct shingle hashes of each item, those of its sketch
    marked; need: how many of the sketch a document must hold.

    Items without words have no rows. Rows that share an item_id count as one item with the shingles of all."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), word_list(F.col(text)).alias("w")).select("item_id", F.explode(shingle_hashes(F.col("w"))).alias("h"))
    sets = rows.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs")).withColumn("n", F.size("hs"))
    sets = sets.withColumn("size_class", F.length(F.bin("n")) - 1)
    largest = F.expr("shiftleft(1, size_class + 1) - 1")
    n = F.col("n")
    sets = sets.withColumn("k", F.least(n, largest - _share(largest, threshold) + 1))
    need = F.greatest(F.col("k") - (n - _share(n, threshold)), F.lit(1))
    marked = sets.select("item_id", n.cast("long").alias("n_item"), "size_class", "k", need.alias("need"), F.posexplode("hs").alias("at", "h"))
    return marked.select("item_id", "h", "n_item", "size_class", "need", (F.col("at") < F.col("k")).alias("in_sketch"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_ROWS) else df


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document that holds at least `threshold` of an item's shingles.

    Null or empty texts and items match nothing, nor do rows without a key. Rows that share a key are one document,
    so repeated rows count once. An item of fewer than five words is its whole word sequence and matches documents of
    just these words. Empty tables give no rows."""
    wanted = durable(item_shingles(items, threshold))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    shingled = lambda d: d.select("doc_id", word_list(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("h"))
    sketch = wanted.where("in_sketch").select("h", "item_id", "need")
    near = shingled(rows).join(_small(sketch), "h").groupBy("doc_id", "item_id", "need").agg(F.count("*").alias("hits"))
    near = durable(near.where("hits >= need").select("doc_id", "item_id"))
    some = rows.join(_small(near.select("doc_id").distinct()), "doc_id", "left_semi")
    held = shingled(some).join(_small(wanted.select("h", "item_id", "n_item")), "h").join(near, ["doc_id", "item_id"], "left_semi")
    held = held.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared")).where(F.col("n_shared") >= _share(F.col("n_item"), threshold))
    out = durable(held.select("doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment")))
    drop_durable(wanted, near)
    return out


ORACLE_SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
docs AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
ish AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM items),
dsh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY 1)
SELECT d.doc_id, i.item_id, n.n_item, count(*) AS n_shared, round(count(*) / n.n_item, 6) AS containment
FROM dsh d JOIN ish i USING (s) JOIN n ON n.item_id = i.item_id
GROUP BY 1, 2, 3 HAVING count(*) * 5 >= n.n_item * 4
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all columns stay. Each row is judged by its own text, with or without a
    doc_id; null and empty texts hold nothing and stay."""
    mark = fresh(docs, "row")
    marked = docs.withColumn(mark, F.xxhash64("text", "doc_id"))
    leaks = contained(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), key=mark)
    gone = durable(leaks.select(F.col("doc_id").alias(mark)).distinct())
    drop_durable(leaks)
    return marked.join(_small(gone), mark, "left_anti").select(*docs.columns)
