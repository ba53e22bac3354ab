"""Quotas, hash-ordered selection, suites and nested subsets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BUCKETS, hard_score, stable_key, text_key
from .components import drop_saved, saved
from .ordering import segmented

#: Shares of the buckets.
RATIOS = dict(zip(BUCKETS, (0.37109, 0.34398, 0.28493), strict=True))


def quotas(n: int, ratios: dict[str, float] = RATIOS) -> dict[str, int]:
    """Largest remainders: whole parts first, then one more for the largest fractions, ties in bucket order."""
    exact = {b: n * r for b, r in ratios.items()}
    out = {b: int(x) for b, x in exact.items()}
    order = sorted(ratios, key=lambda b: -(exact[b] - out[b]))
    for b in order[: n - sum(out.values())]:
        out[b] += 1
    return out


def quota_table(sizes: DataFrame) -> DataFrame:
    """`sizes` (n and any other columns) with a row for each bucket and its quota of n, by largest remainders."""
    shares = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(k).alias("ord"), F.lit(r).alias("ratio")) for k, (b, r) in enumerate(RATIOS.items())])

    def quota(n: Column) -> Column:
        parts = F.transform(shares, lambda x: F.struct(x.bucket.alias("bucket"), x.ord.alias("ord"), F.floor(n * x.ratio).alias("whole"), (n * x.ratio - F.floor(n * x.ratio)).alias("rest")))
        left = n - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.whole)
        before = lambda x: F.size(F.filter(parts, lambda y: (y.rest > x.rest) | ((y.rest == x.rest) & (y.ord < x.ord))))
        return F.transform(parts, lambda x: F.struct(x.bucket.alias("bucket"), (x.whole + (before(x) < left).cast("long")).alias("quota")))

    return sizes.select("*", F.explode(quota(F.col("n"))).alias("x")).select(*sizes.columns, "x.bucket", "x.quota")


def of_bucket(quota: dict[str, int]) -> Column:
    """Quota of the row's bucket."""
    return F.coalesce(*[F.when(F.col("bucket") == b, F.lit(n)) for b, n in quota.items()], F.lit(0))


def reject_reason() -> Column:
    """Why a row with hard_split, split, caption and hard_c isn't eligible, null if it is; the first reason counts."""
    mine, other = text_key(F.coalesce("caption", F.lit(""))), text_key(F.coalesce("hard_c", F.lit("")))
    return (
        F.when(F.col("hard_split").isNull() | (F.col("hard_id") == F.col("image_id")), "missing_target")
        .when((F.col("split") != "train") | (F.col("hard_split") != "train"), "outside_train")
        .when((mine == "") | (other == ""), "empty_text")
        .when(mine == other, "same_text")
    )


def rarity() -> Column:
    """count(label) ** -0.25 within the bucket."""
    return F.pow(F.count("*").over(Window.partitionBy("bucket", "label")).cast("double"), F.lit(-0.25))


def pair_score() -> Column:
    c = F.col
    return hard_score(c("bucket"), c("hard_bucket"), c("video_id"), c("hard_video"), c("action"), c("hard_action"), c("scene"), c("hard_scene"))


def pick_queries(rows: DataFrame, quota: dict[str, int], seed: int, split: str) -> DataFrame:
    """Rows taken as queries: bucket by bucket, unique captions in hash order up to the quota.

    A caption that an earlier bucket took is skipped by later ones, so buckets depend on each other, rows within one don't."""
    rows = rows.withColumn("key", text_key("caption")).where("key <> ''").withColumn("h", stable_key(seed, split, "query", F.col("image_id")))
    taken = None
    for b, n in quota.items():
        own = rows.where(F.col("bucket") == b)
        own = own.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("h", "image_id"))).where("__r = 1").drop("__r")
        if taken is not None:
            own = own.join(taken.select("key"), "key", "left_anti")
        own = own.orderBy("h", "image_id").limit(n)
        taken = own if taken is None else taken.unionByName(own.select(*taken.columns))
    return taken


def fill_gallery(rows: DataFrame, queries: DataFrame, quota: dict[str, int], seed: int, split: str) -> DataFrame:
    """Non-query rows that fill each bucket of the gallery to its quota, queries included, in hash order."""
    have = queries.groupBy("bucket").agg(F.count("*").alias("have"))
    rest = rows.join(queries.select("image_id"), "image_id", "left_anti").withColumn("h", stable_key(seed, split, "gallery", F.col("image_id")))
    rest = segmented(rest, ["bucket"], ["h", "image_id"], "__r").join(have, "bucket", "left")
    return rest.where(F.col("__r") <= of_bucket(quota) - F.coalesce("have", F.lit(0))).drop("__r", "have", "h")


def nested_subsets(ordered: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, image_id): subsets that contain each other, each filling its bucket quotas in order without repeating a text.

    ordered: image_id, bucket, ord, key, hard_key. Size by size and bucket by bucket, the first rows are taken that share no
    text with a row taken before; see first_apart()."""
    rows = saved(ordered.select("image_id", "bucket", "ord", F.xxhash64("key").alias("key"), F.xxhash64("hard_key").alias("hard_key")))
    chosen: list[DataFrame] = []
    have = dict.fromkeys(BUCKETS, 0)
    for k, n in enumerate(sizes):
        for b, q in quotas(n).items():
            if q > have[b]:
                used = functools.reduce(DataFrame.unionByName, [_texts(c) for c in chosen]) if chosen else None
                got = first_apart(rows.where(F.col("bucket") == b), q - have[b], used)
                if got is None:
                    raise ValueError(f"bucket {b} is exhausted at size {n}")
                chosen.append(got.withColumn("from", F.lit(k)))
                have[b] = q
    drop_saved(rows)
    every = functools.reduce(DataFrame.unionByName, chosen)
    return every.select(F.explode(F.slice(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("from") + 1, len(sizes))).alias("size"), "image_id")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("key", "hard_key")).alias("t"))


def _without(rows: DataFrame, texts: DataFrame) -> DataFrame:
    for side in ("key", "hard_key"):
        rows = rows.join(texts.select(F.col("t").alias(side)), side, "left_anti")
    return rows


def first_apart(rows: DataFrame, n: int, used: DataFrame | None = None) -> DataFrame | None:
    """The first n of `rows` (image_id, ord, key, hard_key), saved, that share no text with `used` (t) or an earlier one of them;
    None if there are fewer.

    That is the beginning of the lexicographically first independent set. A row that holds the first use of both its
    texts is in it, whatever other rows do; each round takes all such rows at once and drops those that share a text with
    them. Only a beginning of the rows is looked at, twice as long where repeated texts use it up."""
    left, depth = rows if used is None else _without(rows, used), 4 * n
    while True:
        open_ = saved(left.orderBy("ord").limit(depth).select("image_id", "ord", "key", "hard_key"))
        whole = open_.count() < depth
        taken: list[DataFrame] = []
        while not open_.isEmpty():
            first = open_.select("ord", F.explode(F.array("key", "hard_key")).alias("t")).groupBy("t").agg(F.min("ord").alias("first"))
            free = open_
            for side in ("key", "hard_key"):
                free = free.join(first.select(F.col("t").alias(side), F.col("first").alias(f"first_{side}")), side)
            free = saved(free.where((F.col("first_key") == F.col("ord")) & (F.col("first_hard_key") == F.col("ord"))).select(*open_.columns))
            taken.append(free)
            rest = saved(_without(open_, _texts(free)))
            drop_saved(open_)
            open_ = rest
        drop_saved(open_)
        if taken and sum(t.count() for t in taken) >= n:
            out = saved(functools.reduce(DataFrame.unionByName, taken).orderBy("ord").limit(n))
            drop_saved(*taken)
            return out
        drop_saved(*taken)
        if whole:
            return None
        depth *= 2
