"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, dim: int) -> Column:
    """Inner product of the first `dim` elements in double precision, added from left to right; null if one is missing.

    A fold over products: written out element by element, the generated method would be too large to be compiled."""
    products = F.zip_with(F.slice(a, 1, dim), F.slice(b, 1, dim), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """`v` divided by its length, by `eps` if that is smaller."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(eps)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def temperature(logit_scale: Column, low: float = 1e-3, high: float = 0.5) -> Column:
    """1 / exp(logit_scale) within [low, high]."""
    return clamp(F.exp(-logit_scale), low, high)


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts joined by colons; the same in every run and partitioning."""
    h = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)
