"""Leakage-free splits: connected components of videos, dealt to splits by need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import stable_key
from .components import connected, saved
from .guards import ContractError
from .ordering import numbered

RATIOS = {"train": 0.8, "dev": 0.1, "report": 0.1}


def video_components(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(video_id, component): videos that hard pairs connect; component is the smallest video. Rows: image_id, hard_id, video_id.

    A row whose target isn't there, and an image in two videos, break the contract: a pair could be split unseen. Unless
    `strict`, a row whose target isn't there has no edge, and a video that no edge meets is left out."""
    twice, lost = Observation(), Observation()
    video = rows.groupBy("image_id").agg(F.min("video_id").alias("hard_video"), F.max("video_id").alias("__last"))
    video = video.observe(twice, F.max(F.when(F.col("hard_video") != F.col("__last"), F.col("image_id"))).alias("image"))
    both = rows.select("hard_id", "video_id").join(video.select(F.col("image_id").alias("hard_id"), "hard_video"), "hard_id", "left" if strict else "inner")
    both = both.observe(lost, F.max(F.when(F.col("hard_video").isNull(), F.col("hard_id"))).alias("target"))
    edges = saved(both.select(F.col("video_id").alias("src"), F.coalesce("hard_video", "video_id").alias("dst")))
    # Both contracts are checked by the job that writes the edges.
    for seen, name, message in ((lost, "target", "hard targets are missing"), (twice, "image", "images in several videos")):
        if seen.get[name] is not None:
            raise ContractError(f"{message}: {seen.get[name]}")
    return connected(edges).select(F.col("node").alias("video_id"), "component")


def component_sizes(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(component, n_rows, n_videos)."""
    return rows.join(components, "video_id").groupBy("component").agg(F.count("*").alias("n_rows"), F.count_distinct("video_id").alias("n_videos"))


def ordered(sizes: DataFrame, seed: int = 2026) -> DataFrame:
    """`sizes` with the order in which components are dealt: larger first, then by stable hash."""
    return sizes.withColumn("key", stable_key(seed, "split", "component", F.col("component")))


def _dealt_counts(sizes: list[tuple[int, int]], ratios: dict[str, float]) -> list[tuple[int, int, int, int, float]]:
    """(size, split, rows held before, components dealt, target) for each size, larger first: how many components each split gets.

    While components of one size are dealt, a split's need falls by the same amount each time it is chosen, so the
    choices are the largest needs of all splits. All but a few of them follow from where the needs meet; those are taken
    one by one, with ties as in deal()."""
    total = sum(n * c for n, c in sizes)
    target = [total * r for r in ratios.values()]
    held, out = [0] * len(target), []
    for n, c in sorted(sizes, reverse=True):
        need = [(t - h) / t for t, h in zip(target, held, strict=True)]
        low, high = min(need) - c * n / min(target) - 1, max(need)
        count = lambda level: [max(0, math.floor((x - level) * t / n)) for x, t in zip(need, target, strict=True)]  # noqa: E731, B023
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(count(middle)) > c else (low, middle)
        got = [max(0, x - len(target)) for x in count(high)]
        while sum(got) < c:
            now = [h + n * g for h, g in zip(held, got, strict=True)]
            got[min(range(len(target)), key=lambda k: (-(target[k] - now[k]) / target[k], now[k], k))] += 1  # noqa: B023
        out += [(n, k, held[k], g, target[k]) for k, g in enumerate(got) if g]
        held = [h + n * g for h, g in zip(held, got, strict=True)]
    return out


def deal(sizes: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = 2026) -> DataFrame:
    """(component, n_rows, split): each component goes to the split with the largest share of its target still open.

    Ties go to the split with fewer rows, then to the earlier one. Each decision depends on all before it, but only
    through the rows that the splits hold. So the driver folds over the table of sizes (a table of N rows has fewer
    than sqrt(2 N) different sizes) and finds how many components of each size go where; within a size the splits'
    needs, in falling order, give the turns, which meet the components by number."""
    spark = sizes.sparkSession
    rows = saved(ordered(sizes, seed))
    counts = _dealt_counts([(r.n_rows, r.c) for r in rows.groupBy("n_rows").agg(F.count("*").alias("c")).collect()], ratios)
    turns = spark.createDataFrame(counts, "n_rows long, split int, held long, c long, target double").select("n_rows", "split", "held", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("j"))
    turns = turns.withColumn("now", F.col("held") + F.col("j") * F.col("n_rows"))
    turns = turns.select((-F.col("n_rows")).alias("neg"), (-(F.col("target") - F.col("now")) / F.col("target")).alias("d"), "now", "split")
    turns = numbered(turns, ["neg", "d", "now", "split"]).select("rn", "split")
    names = F.array(*[F.lit(n) for n in ratios])
    placed = numbered(rows.withColumn("neg", -F.col("n_rows")), ["neg", "key", "component"])
    return placed.join(turns, "rn").select("component", "n_rows", F.get(names, F.col("split")).alias("split"))


def by_video(components: DataFrame, dealt: DataFrame) -> DataFrame:
    """(video_id, split)."""
    return components.join(dealt.select("component", "split"), "component").select("video_id", "split")


def leakage(rows: DataFrame, split_of: DataFrame) -> DataFrame:
    """Hard pairs whose ends are in different splits: (image_id, hard_id, split, hard_split). Empty when all is well."""
    mine = rows.join(split_of, "video_id").select("image_id", "hard_id", "split")
    other = rows.join(split_of, "video_id").select(F.col("image_id").alias("hard_id"), F.col("split").alias("hard_split"))
    return mine.join(other, "hard_id").where("split <> hard_split")
