"""Batch plans as tables: every draw is a hash of seed, epoch and row, so plans don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_key
from ..functions.vector import hash_uniform
from .components import saved
from .ordering import numbered, segmented


def pair_batches(pairs: DataFrame, batch: int, epoch: int, seed: int = 2026) -> DataFrame:
    """(epoch, batch, slot, a, b, grp): batches of batch/2 pairs with distinct groups; every pair at most once.

    Pairs in the order of their groups are dealt to the batches in turn: a group has no more pairs than there are
    batches, so they go to different ones. There are as many full batches as any plan could have; what is left is fewer
    pairs than a batch takes, and of a group with more pairs than batches the rest in hash order."""
    if batch % 2:
        raise ValueError("batch size must be even")
    k = batch // 2
    h = stable_key(seed, epoch, "pair", F.concat_ws("-", "a", "b"))
    order = ["gh", "grp", "h", "a", "b"]
    rows = numbered(pairs.select("a", "b", "grp", h.alias("h"), stable_key(seed, epoch, "group", F.col("grp")).alias("gh")), order)
    groups = saved(rows.groupBy("grp").agg(F.min("rn").alias("first"), F.count("*").alias("size")))
    kept = rows.join(groups, "grp").crossJoin(F.broadcast(_full_batches(groups, k))).where(F.col("rn") - F.col("first") < F.col("full"))
    dealt = numbered(kept.select("a", "b", "grp", "full", F.col("rn").alias("at")), "at").where(F.col("rn") <= F.col("full") * k)
    at = F.col("rn") - 1
    return dealt.select(F.lit(epoch).alias("epoch"), (at % F.col("full")).alias("batch"), F.floor(at / F.col("full")).alias("slot"), "a", "b", "grp")


def _full_batches(groups: DataFrame, k: int) -> DataFrame:
    """(full): the largest number B of batches of k pairs for which the groups, with at most B pairs each, have B * k.

    Between two sizes that occur, small groups give all they have and each larger one gives B; so few rows decide."""
    sizes = groups.groupBy("size").agg(F.count("*").alias("c"))
    upto = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    zero = sizes.sparkSession.createDataFrame([(0, 0)], "size long, c long")
    steps = sizes.unionByName(zero).withColumn("small", F.sum(F.col("size") * F.col("c")).over(upto)).withColumn("larger", F.sum("c").over(Window.partitionBy()) - F.sum("c").over(upto))
    steps = steps.withColumn("next", F.lead("size").over(Window.orderBy("size")))
    most = F.when(F.col("larger") >= k, F.col("next")).otherwise(F.least(F.coalesce("next", F.col("small")), F.floor(F.col("small") / (k - F.col("larger")))))
    return steps.select(F.when(most >= F.col("size"), most).alias("most")).agg(F.coalesce(F.max("most"), F.lit(0)).alias("full"))


def unpaired(plan: DataFrame) -> DataFrame:
    """(epoch, batch, pos, row_id, partner_pos): both rows of each pair next to each other; partners point at each other."""
    two = F.explode(F.array(F.struct((F.col("slot") * 2).alias("pos"), F.col("a").alias("row_id")), F.struct((F.col("slot") * 2 + 1).alias("pos"), F.col("b").alias("row_id")))).alias("x")
    return plan.select("epoch", "batch", two).select("epoch", "batch", "x.pos", "x.row_id", F.col("x.pos").bitwiseXOR(F.lit(1).cast("long")).alias("partner_pos"))


def match_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., i, j, label) for rows with pos and partner_pos: (i, i, 1), (i, partner, 0), (partner, i, 0)."""
    three = F.array(
        F.struct(F.col("pos").alias("i"), F.col("pos").alias("j"), F.lit(1).alias("label")),
        F.struct(F.col("pos").alias("i"), F.col("partner_pos").alias("j"), F.lit(0).alias("label")),
        F.struct(F.col("partner_pos").alias("i"), F.col("pos").alias("j"), F.lit(0).alias("label")),
    )
    return rows.select(*by, F.explode(three).alias("x")).select(*by, "x.*")


def mixed_batches(pairs: DataFrame, rows: DataFrame, batch: int, hard: int, epoch: int, seed: int = 2026) -> DataFrame:
    """(epoch, batch, pos, row_id): `hard` pairs first, then fillers in hash order; a batch holds a row once.

    Each batch takes the next fillers of the epoch's order, with spares for those that its own pairs hold already."""
    if 2 * hard > batch:
        raise ValueError("pairs don't fit the batch")
    plan = unpaired(pair_batches(pairs, 2 * hard, epoch, seed)).select("epoch", "batch", "pos", "row_id")
    need = batch - 2 * hard
    n = rows.count()
    wide = need + 2 * hard
    order = numbered(rows.select(F.col("row_id"), stable_key(seed, epoch, "filler", F.col("row_id")).alias("h")), "h").select("row_id", (F.col("rn") - 1).alias("at"))
    if n < batch:
        raise ValueError("fewer rows than a batch needs")
    starts = plan.select("batch").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))).withColumn("at", (F.col("batch") * wide + F.col("k")) % n)
    spare = starts.join(order, "at").join(plan.select("batch", "row_id"), ["batch", "row_id"], "left_anti")
    fill = spare.withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy("k"))).where(F.col("r") <= need)
    return plan.unionByName(fill.select(F.lit(epoch).alias("epoch"), "batch", (F.col("r") - 1 + 2 * hard).alias("pos"), "row_id"))


def grouped_batches(rows: DataFrame, batch: int, share: float, epoch: int, seed: int = 2026) -> DataFrame:
    """(epoch, batch, pos, row_id): for each whole batch that the rows (row_id, grp) make, up to round(share * batch) rows of a
    group drawn for it, then rows of the whole table in hash order.

    The visits to a group walk through permutations of it: a lap has as many visits as find new rows, the next lap is
    another permutation, by the hash of (epoch, group, lap), so no row is left out for good and none twice in a visit. A row
    of the fill may also be in the group part. Rows without a group only fill."""
    g, n = round(share * batch), rows.count()
    total = n // batch
    size = rows.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count("*").alias("size")).withColumn("m", F.least("size", F.lit(g)))
    groups = saved(numbered(size.where("m > 0"), "grp", name="gi"))
    kinds = groups.count()
    every = rows.sparkSession.range(total).withColumnRenamed("id", "batch")
    drawn = F.conv(F.substring(stable_key(seed, epoch, "pick", F.col("batch")), 1, 12), 16, 10).cast("long") % max(1, kinds) + 1
    visits = saved(segmented(every.withColumn("gi", drawn).join(groups, "gi"), ["gi"], ["batch"], "v").withColumn("per_lap", F.floor(F.col("size") / F.col("m"))))
    visits = visits.withColumn("lap", F.floor((F.col("v") - 1) / F.col("per_lap"))).withColumn("turn", (F.col("v") - 1) % F.col("per_lap"))
    laps = visits.select("grp", "lap", "m").distinct().join(rows, "grp").withColumn("h", stable_key(seed, epoch, "lap", F.concat_ws("-", "grp", "lap", "row_id")))
    laps = segmented(laps, ["grp", "lap"], ["h", "row_id"], "p").withColumn("turn", F.floor((F.col("p") - 1) / F.col("m")))
    part = laps.join(visits.select("grp", "lap", "turn", "batch"), ["grp", "lap", "turn"]).select("batch", ((F.col("p") - 1) % F.col("m")).alias("pos"), "row_id")
    order = numbered(rows.select("row_id", stable_key(seed, epoch, "fill", F.col("row_id")).alias("h")), ["h", "row_id"]).where(F.col("rn") <= total * batch)
    fill = order.select(F.floor((F.col("rn") - 1) / batch).alias("batch"), ((F.col("rn") - 1) % batch).alias("k"), "row_id")
    fill = fill.join(visits.select("batch", "m"), "batch", "left").withColumn("m", F.coalesce("m", F.lit(0))).where(F.col("k") < batch - F.col("m"))
    return part.unionByName(fill.select("batch", (F.col("k") + F.col("m")).alias("pos"), "row_id")).select(F.lit(epoch).alias("epoch"), "batch", "pos", "row_id")


def sampled_negatives(pairs: DataFrame, by: list[str], temperature: float, seed: int = 2026) -> DataFrame:
    """(by..., i, j): one column per row, drawn with probability softmax(sim / T) among allowed ones (Gumbel maximum).

    pairs: by..., i, j, sim, forbidden. Where all columns are forbidden the draw is uniform over those other than the row."""
    u = hash_uniform(F.lit(seed), *[F.col(c) for c in by], F.col("i"), F.col("j"))
    noise = -F.log(-F.log(F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-12))))
    allowed = F.when(~F.col("forbidden"), F.col("sim") / temperature + noise)
    drawn = pairs.groupBy(*by, "i").agg(F.max_by("j", allowed).alias("a"), F.max(allowed).alias("has"), F.max_by("j", F.when(F.col("i") != F.col("j"), noise)).alias("any"))
    return drawn.select(*by, "i", F.when(F.col("has").isNotNull(), F.col("a")).otherwise(F.col("any")).alias("j"))


def augment_spec(rows: DataFrame, families: dict[str, float], keep: int = 2, seed: int = 2026) -> DataFrame:
    """row_id with specs: up to `keep` of the families that a hash draw turns on, in hash order, with a strength each."""
    def one(name: str, p: float) -> Column:
        on = hash_uniform(F.lit(seed), F.lit(name), F.lit("on"), F.col("row_id")) < p
        return F.when(on, F.struct(hash_uniform(F.lit(seed), F.lit(name), F.lit("order"), F.col("row_id")).alias("o"), F.lit(name).alias("name"), F.round(hash_uniform(F.lit(seed), F.lit(name), F.lit("strength"), F.col("row_id")), 6).alias("strength")))

    drawn = F.slice(F.array_sort(F.array_compact(F.array(*[one(n, p) for n, p in families.items()]))), 1, keep)
    return rows.select("row_id", F.array_join(F.transform(drawn, lambda x: F.concat(x["name"], F.lit("="), F.format_string("%.6f", x.strength))), ",").alias("spec"))
