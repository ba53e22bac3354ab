"""Box and keypoint expressions; boxes are arrays of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detections(found: Column, kind: int = 0, confidence: float = 0.2) -> Column:
    """Of array<struct<cls, conf, ...>> the ones of class `kind` with at least this confidence."""
    return F.filter(found, lambda x: (x.cls == kind) & (x.conf >= confidence))


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def xyxy_to_xywh(b: Column, least: float = 1e-6) -> Column:
    """Corner box as x, y, width, height; sides are at least `least`; null unless it has four numbers."""
    return F.when(F.size(b) == 4, F.array(b[0], b[1], F.greatest(b[2] - b[0], F.lit(least)), F.greatest(b[3] - b[1], F.lit(least))))


def expand_xywh(b: Column, margin: float = 0.125) -> Column:
    """Corner box that is larger by `margin` of each side, within the unit square."""
    return F.array(_clip(b[0] - b[2] * margin), _clip(b[1] - b[3] * margin), _clip(b[0] + b[2] * (1 + margin)), _clip(b[1] + b[3] * (1 + margin)))


def normalize_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Pixel corners as shares of width and height within [0, 1]; a size of 0 or null counts as 1."""
    side = lambda v: F.when(F.coalesce(v, F.lit(0)) == 0, F.lit(1.0)).otherwise(v.cast("double"))
    return F.array(_clip(x1 / side(width)), _clip(y1 / side(height)), _clip(x2 / side(width)), _clip(y2 / side(height)))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def parse_list(cell: Column, n: int) -> Column:
    """A JSON list of exactly `n` numbers as array<double>, else null."""
    v = F.from_json(cell, "array<double>")
    return F.when((F.size(v) == n) & ~F.exists(v, lambda x: x.isNull()), v)


def flat_keypoints(status: Column, points: Column, width: Column, height: Column, n: int = 17) -> Column:
    """x / width, y / height, confidence of `n` points in a row; null unless the status is ok and all points are there."""
    side = lambda v: F.when(F.coalesce(v, F.lit(0)) == 0, F.lit(1.0)).otherwise(v.cast("double"))
    return F.when((status == "ok") & (F.size(points) == n), F.flatten(F.transform(points, lambda p: F.array(p[0] / side(width), p[1] / side(height), p[2]))))
