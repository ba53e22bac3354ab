"""Selection of variants and checkpoints, loss weighting, schedules and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_best(variants: DataFrame, eps: float = 1e-9) -> DataFrame:
    """The variant with the best map, r1, r5, then fewest conflicts among those with r10 >= floor - eps, or among all if none has."""
    safe = (F.col("r10") >= F.col("floor") - eps).cast("int")
    return variants.orderBy(F.desc(safe), F.desc("map"), F.desc("r1"), F.desc("r5"), "conflicts", "alpha", "method").limit(1)


def lr_schedule(step: Column, warm_up: int, total: int | Column) -> Column:
    """Linear warm-up, then half a cosine."""
    total = total if isinstance(total, Column) else F.lit(total)
    progress = F.least(F.lit(1.0), (step - warm_up) / F.greatest(F.lit(1), total - warm_up).cast("double"))
    return F.when(step < warm_up, (step + 1) / F.lit(float(max(1, warm_up)))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def dynamic_weights(losses: DataFrame, names: list[str], order: str, temperature: float = 2.0, by: str | None = None) -> DataFrame:
    """Weights K softmax((L[-1] / max(L[-2], 1e-8)) / T) from the two rows before (of the run, if `by` names it); 1 where there are none."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    ratio = {n: F.lag(n, 1).over(w) / F.greatest(F.lag(n, 2).over(w), F.lit(1e-8)) / temperature for n in names}
    df = losses.select("*", *[ratio[n].alias(f"__r_{n}") for n in names])
    total = sum((F.exp(F.col(f"__r_{n}")) for n in names[1:]), F.exp(F.col(f"__r_{names[0]}")))
    return df.select(*([by] if by else []), order, *[F.coalesce(len(names) * F.exp(F.col(f"__r_{n}")) / total, F.lit(1.0)).alias(f"w_{n}") for n in names])


def early_stop(log: DataFrame, patience: int, floor: float, by: list[str] | None = None) -> DataFrame:
    """One row (per run, given by `by`): best evaluation, its value, and where training stops.

    An evaluation is accepted if its r10 is at least `floor` and its map beats the best so far; `patience` rejections in a row
    stop. The log of one run is a few hundred rows, folded in order inside one row."""
    by = by or []
    rows = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "map", "r10"))).alias("log"))
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(-1).cast("long").alias("best_step"), F.lit(0).alias("bad"), F.lit(-1).cast("long").alias("stop_step"))

    def step(a: Column, x: Column) -> Column:
        good = (x.map > a.best) & (x.r10 >= F.lit(floor))
        bad = F.when(good, F.lit(0)).otherwise(a.bad + 1)
        after = F.struct(
            F.when(good, x.map).otherwise(a.best).alias("best"), F.when(good, x.step).otherwise(a.best_step).alias("best_step"),
            bad.alias("bad"), F.when(bad >= patience, x.step).otherwise(F.lit(-1).cast("long")).alias("stop_step"),
        )
        return F.when(a.stop_step >= 0, a).otherwise(after)

    return rows.select(*by, F.aggregate("log", start, step).alias("x")).select(*by, "x.best_step", "x.best", "x.bad", "x.stop_step")


def percent(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x * 100, 2))
