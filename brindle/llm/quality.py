"""Quality classifier: a linear support vector machine on n-gram indicators scaled by Naive Bayes log-count ratios.

Indicators say which hashed n-grams a text holds: byte trigrams, words, and runs of one to three word shapes (what
kind of characters a word begins and ends with, and whether it repeats the word before it). Each indicator is
scaled by the log ratio of its smoothed counts in the two classes; the vector gets length 1. A hinge loss is fitted
by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, slices, words

#: Most labelled documents of each class that the model is fitted on.
PER_CLASS = 800
_TRI, _WORD, _SHAPE = 1 << 17, 1 << 17, 1 << 15
DIM = _TRI + _WORD + _SHAPE
_U = np.uint64
_KIND = np.arange(256, dtype=np.uint64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3


def indicators(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, feature numbers present) for each document of a flat buffer."""
    seen = np.zeros(DIM, bool)
    for i, j in slices(off, 1 << 18):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        w, at, doc = words(part, o)
        big = part.astype(np.uint32)
        tri = ((big[:-2] << 16 | big[1:-1] << 8 | big[2:]) * np.uint32(0x9E3779B1) >> np.uint32(15)).astype(np.int64) if len(part) > 2 else np.zeros(0, np.int64)
        word = _TRI + (w >> _U(47)).astype(np.int64)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        if len(w):
            blank = np.zeros(256, bool)
            blank[[9, 10, 11, 12, 13, 32]] = True
            solid = ~blank[part]
            ends = solid.copy()
            ends[:-1] &= ~solid[1:]
            inner = o[1:-1]
            inner = inner[(inner > 0) & (inner < len(part))]
            ends[inner - 1] = solid[inner - 1]
            last = np.flatnonzero(ends)
            kind = _KIND[part]
            again = np.zeros(len(w), np.uint64)
            again[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
            shape = mix(kind[at] | kind[np.minimum(at + 1, last)] << _U(9) | kind[last] << _U(18) | kind[np.maximum(last - 1, at)] << _U(27) | again << _U(36))
            two = mix(shape[:-1] * _U(3) + shape[1:])
            three = mix(two[:-1] * _U(5) + shape[2:])
            runs = [(x >> _U(49)).astype(np.int64) + (_TRI + _WORD) for x in (shape, two, three)]
        for k in range(j - i):
            s, e, a, b = o[k], o[k + 1], cut[k], cut[k + 1]
            seen[tri[s : max(s, e - 2)]] = True
            if b > a:
                seen[word[a:b]] = True
                for n, r in enumerate(runs):
                    seen[r[a : max(a, b - n)]] = True
            on = np.flatnonzero(seen)
            seen[on] = False
            yield i + k, on


def fit(texts: list[str], y: list[int], c: float = 1.0, rounds: int = 8, alpha: float = 1.0) -> dict:
    """Weights folded with the log-count ratios: margin = v[on].sum() / sqrt(q[on].sum()) + b."""
    if len(set(y)) < 2:
        return {"v": np.zeros(DIM, np.float32), "q": np.ones(DIM, np.float32), "b": 1.0 if not y or y[0] else -1.0}
    data, off = flat(pa.array(texts, pa.large_string()))
    rows = [on for _, on in indicators(data, off)]
    sign = np.where(np.array(y) == 1, 1.0, -1.0)
    up, down = np.full(DIM, alpha), np.full(DIM, alpha)
    for on, s in zip(rows, sign, strict=True):
        (up if s > 0 else down)[on] += 1
    r = np.log(up / ((sign > 0).sum() + 2 * alpha)) - np.log(down / ((sign < 0).sum() + 2 * alpha))
    vals = [r[on] / max(1e-9, np.sqrt((r[on] ** 2).sum())) for on in rows]
    cost = c * np.where(sign > 0, len(sign) / (2 * (sign > 0).sum()), len(sign) / (2 * (sign < 0).sum()))
    w, b, dual, rng = np.zeros(DIM), 0.0, np.zeros(len(rows)), np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            on, x = rows[i], vals[i]
            grad = sign[i] * (w[on] @ x + b) - 1
            new = min(max(dual[i] - grad / 2.0, 0.0), cost[i])  # |x|^2 = 1, and 1 for the bias
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[on] += step * x
                b += step
                dual[i] = new
    return {"v": (w * r).astype(np.float32), "q": (r * r).astype(np.float32), "b": float(b)}


def margin(model: dict, on: np.ndarray) -> float:
    return float(model["v"][on].sum() / max(1e-9, np.sqrt(model["q"][on].sum())) + model["b"]) if len(on) else model["b"]


def score(df: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with score (0 to 1) and predicted (1 if score >= 0.5). Null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM floats twice, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = flat(b.column(0))
            got = np.array([margin(m, on) for _, on in indicators(data, off)])
            p = 1 / (1 + np.exp(-np.clip(3 * got, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, f"{fields}, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Fit on at most `per_class` documents of each class, taken by hash of doc_id among labelled rows where `usable` holds.

    A doc_id with several labels counts with its smallest; labels that aren't 0 or 1 are left out. The sample's ids
    are bounded by the parameter, so they are broadcast to the scan of the texts."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).alias("y"))
    n = {r[0]: r[1] for r in ids.groupBy("y").count().collect()}
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    want = F.lit(False)
    for k, c in n.items():
        want = want | ((F.col("y") == k) & (u < per_class / c))
    some = [r for k in n for r in ids.where(want & (F.col("y") == k)).select("doc_id", "y").orderBy(u).limit(per_class).collect()]
    if not some:
        return fit([], [])
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in some], "__id long, __y int"))
    rows = docs.join(picked, docs.doc_id == picked["__id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "__y").toLocalIterator()
    got = sorted((r.doc_id, r.t, r["__y"]) for r in rows)
    return fit([t for _, t, _ in got], [y for *_, y in got])


def assess(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from rows whose crc32(doc_id as text) mod 3 is not 1.

    Repeated rows give repeated rows. Without labels of both classes every document gets the one class seen (1 if none)."""
    out_fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = learn(docs, labels, ~out_fold, per_class=per_class)
    return score(docs, model).select("doc_id", out_fold.alias("held_out"), "score", "predicted")
