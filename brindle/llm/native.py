"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits of a text; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column, size: int = 5) -> Column:
    """64-bit hashes of every run of `size` words; fewer words: the whole sequence as one; none: empty."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array of ints, in two levels so that long arrays stay cheap."""
    zero = F.lit(0)
    total = lambda x: F.aggregate(x, zero, lambda a, y: a + y)
    at = lambda i: F.floor(i / block).cast("int")

    def sums(x: Column) -> Column:
        per = F.transform(F.sequence(zero, at(F.size(x) - 1)), lambda b: total(F.slice(x, b * block + 1, block)))
        starts = let(per, lambda p: F.transform(F.sequence(zero, F.size(p) - 1), lambda b: total(F.slice(p, F.lit(1), b))))
        return let(starts, lambda s: F.transform(F.sequence(zero, F.size(x) - 1), lambda i: F.get(s, at(i)) + total(F.slice(x, at(i) * block + 1, i % block))))

    return let(lengths, lambda x: F.when(F.size(x) > 0, sums(x)).otherwise(F.array().cast("array<int>")))
