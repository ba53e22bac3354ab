"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into parts of WIDTH components; each part is stored as the number of the nearest of up to CENTRES
centroids, fitted on a bounded sample of the rows, with the norm of what the centroid leaves over. For an anchor a
table of inner products of its parts with all centroids gives each row's score by look-ups; the true score differs by
at most the sum over the parts of the anchor's norm times the residual norm. Rows lie in blocks of BLOCK, and anchors,
the stated query set, meet each block. In a block the bounds rule out rows that can't be among the best, or can't be in
a window of scores; only the others' exact scores, inner products of whole numbers, are computed, and these alone
decide. So the result is exact, and a few rows of each anchor and block are all that is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_durable, durable, fits_broadcast, trimmed
from .vectors import lists, matrix

#: Components of a part, centroids of a part, and rows of the sample that they are fitted on.
WIDTH, CENTRES, SAMPLE, STEPS = 4, 256, 8192, 8
#: Rows of a block, and anchors that meet it in one task.
BLOCK, ANCHOR_BLOCK = 4096, 4096
BROADCAST_BLOCKS = 100_000
POSITIVES, NEGATIVES = 5, 3
_MARGIN = 1e-9


def codebooks(x: np.ndarray, width: int = WIDTH, centres: int = CENTRES, steps: int = STEPS) -> list[np.ndarray]:
    """Centroids of each part of the rows of x by k-means from evenly spaced distinct rows; the last part may be narrower."""
    books = []
    for at in range(0, x.shape[1], width):
        part = x[:, at : at + width]
        distinct = np.unique(part, axis=0)
        c = distinct[np.linspace(0, len(distinct) - 1, min(centres, len(distinct))).astype(int)]
        for _ in range(steps if len(distinct) > centres else 0):
            near = _codes_of(part, c)
            sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(sums, near, part)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books.append(c)
    return books


def _codes_of(part: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (part @ c.T)).argmin(1)


def encode(x: np.ndarray, books: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms) of the rows of x, a column for each part."""
    codes, left = np.empty((len(x), len(books)), np.uint8), np.empty((len(x), len(books)))
    for m, c in enumerate(books):
        part = x[:, m * width : (m + 1) * width]
        codes[:, m] = near = _codes_of(part, c)
        left[:, m] = np.sqrt(((part - c[near]) ** 2).sum(1))
    return codes, left


class _Block:
    """Rows of a block with their codes, and the bounds of an anchor's scores."""

    def __init__(self, t: pa.Table, books: list[np.ndarray], dim: int):
        t = t.sort_by("vec_id")
        self.books, self.ids, self.label = books, t["vec_id"].to_numpy(), t["label"].to_numpy()
        self.x = matrix(t["v"], dim)
        self.codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(t), len(books))
        self.left = matrix(t["left"], len(books)).astype(float)
        self.columns = np.ascontiguousarray(self.codes.T).astype(np.int64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) possible scores of all rows."""
        score, norms = np.zeros(len(self.ids)), []
        for m, c in enumerate(self.books):
            part = q[m * WIDTH : (m + 1) * WIDTH]
            score += (c @ part)[self.columns[m]]
            norms.append(math.sqrt(float(part @ part)))
        wide = self.left @ np.array(norms)
        wide += _MARGIN * (np.abs(score) + wide) + 1e-6
        return score - wide, score + wide

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.x[rows] @ q


def _largest(x: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -math.inf


def _best(block: _Block, rows: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the k best of `rows`."""
    rows = rows[high[rows] >= _largest(low[rows], k)]
    s = block.exact(rows, q)
    order = np.lexsort((block.ids[rows], -s))[:k]
    return rows[order], s[order]


def window(positive: int) -> tuple[int, int]:
    """Smallest and largest negative score s with 50 * positive <= 100 * s <= 95 * positive."""
    return -((-positive) // 2), (95 * positive) // 100


def _within(block: _Block, rows: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the k best of `rows` with scores from `first` to `last`."""
    rows = rows[(high[rows] >= first) & (low[rows] <= last)]
    sure = rows[(low[rows] >= first) & (high[rows] <= last)]
    rows = rows[high[rows] >= _largest(low[sure], k)]
    s = block.exact(rows, q)
    inside = (s >= first) & (s <= last)
    rows, s = rows[inside], s[inside]
    order = np.lexsort((block.ids[rows], -s))[:k]
    return rows[order], s[order]


class Quantised:
    """Rows (vec_id, v, label) with codes and residual norms in blocks, as a saved table; drop() deletes it.

    Rows without a label take no part; v is as vectors.scaled() gives it, shorter ones count as padded with zeros. The
    codebooks are fitted on the SAMPLE rows with the smallest hashes."""

    def __init__(self, rows: DataFrame):
        rows = durable(rows.where("label IS NOT NULL").select("vec_id", "v", F.col("label").cast("long").alias("label")))
        got = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        self.spark, self.n, self.dim = rows.sparkSession, got.n, got.dim or 0
        if not self.n:
            drop_durable(rows)
            return
        few = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
        self.books = codebooks(matrix(few["v"], self.dim))
        dim, books = self.dim, self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, count = TaskContext.get().partitionId(), 0
            for b in batches:
                codes, left = encode(matrix(b["v"], dim), books)
                block = (part << 32) + (count + np.arange(b.num_rows)) // BLOCK
                count += b.num_rows
                yield pa.RecordBatch.from_arrays([*[b[c] for c in ("vec_id", "v", "label")], pa.array([c.tobytes() for c in codes], pa.binary()), lists(left), pa.array(block)], ["vec_id", "v", "label", "codes", "left", "block"])

        self.rows = durable(rows.mapInArrow(trimmed(run), "vec_id long, v array<double>, label long, codes binary, left array<double>, block long"))
        self.blocks = durable(self.rows.select("block").distinct())
        drop_durable(rows)

    def drop(self) -> None:
        if self.n:
            drop_durable(self.rows, self.blocks)

    def _meet(self, anchors: DataFrame, count: int, step, schema: str) -> DataFrame:
        """`step` (a function of a block and a table of anchors, giving rows of `schema`) for each block and part of the anchors."""
        parts, dim, books = max(1, math.ceil(count / ANCHOR_BLOCK)), self.dim, self.books
        names = [c.split()[0] for c in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = step(_Block(left, books, dim), right) if len(left) and len(right) else []
            return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})

        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        few = F.broadcast(self.blocks) if fits_broadcast(self.blocks, BROADCAST_BLOCKS) else self.blocks
        asked = anchors.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int")).crossJoin(few.withColumnRenamed("block", "of"))
        return self.rows.select("*", part).groupBy("block", "part").cogroup(asked.groupBy("of", "part")).applyInArrow(run, schema)

    def positives(self, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
        """(anchor_id, positive_id, positive_score): the k best other rows of each anchor's label. anchors: anchor_id, q, label;
        saved. Repeated rows count as often as they occur."""
        dim = self.dim

        def step(block: _Block, asked: pa.Table) -> list[tuple]:
            out = []
            for a, q, label in zip(asked["anchor_id"].to_pylist(), matrix(asked["q"], dim), asked["label"].to_pylist(), strict=True):
                rows = np.flatnonzero((block.label == label) & (block.ids != a))
                if len(rows):
                    rows, s = _best(block, rows, *block.bounds(q), q, k)
                    out += [(a, int(block.ids[r]), int(x)) for r, x in zip(rows, s, strict=True)]
            return out

        hits = self._meet(anchors.select("anchor_id", "q", "label"), anchors.count(), step, "anchor_id long, positive_id long, positive_score long")
        place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        return hits.withColumn("place", place).where(F.col("place") <= k).drop("place")

    def negatives(self, anchors: DataFrame, positives: DataFrame, k: int = NEGATIVES) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the k best rows of another label in the
        window of each distinct (anchor, positive, score)."""
        dim = self.dim
        of = positives.distinct().groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))  # a few a row

        def step(block: _Block, asked: pa.Table) -> list[tuple]:
            out = []
            for a, q, label, windows in zip(asked["anchor_id"].to_pylist(), matrix(asked["q"], dim), asked["label"].to_pylist(), asked["windows"].to_pylist(), strict=True):
                rows = np.flatnonzero(block.label != label)
                if not len(rows):
                    continue
                low, high = block.bounds(q)
                for w in windows:
                    got, s = _within(block, rows, low, high, q, *window(w["positive_score"]), k)
                    out += [(a, w["positive_id"], int(block.ids[r]), w["positive_score"], int(x)) for r, x in zip(got, s, strict=True)]
            return out

        asked = durable(anchors.join(of, "anchor_id").select("anchor_id", "q", "label", "windows"))
        hits = durable(self._meet(asked, asked.count(), step, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"))
        drop_durable(asked)
        place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
        return hits.withColumn("rank", place).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of `anchors` (anchor_id, q, label) among `rows` (vec_id, v, label); see Quantised. An anchor id that
    occurs in several rows is asked once, with the smallest vector. Empty tables, and anchors without another row of
    their label, give no rows."""
    index = Quantised(rows)
    if not index.n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = durable(anchors.where("label IS NOT NULL").groupBy("anchor_id").agg(F.min(F.struct("q", F.col("label").cast("long").alias("label"))).alias("x")).select("anchor_id", "x.*"))
    positives = durable(index.positives(asked))
    out = index.negatives(asked, positives)
    index.drop()
    drop_durable(asked, positives)
    return out


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
w AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""
