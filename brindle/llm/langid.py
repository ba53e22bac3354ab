"""Language identification by error-correcting output codes.

Each language has a codeword. One binary linear classifier per code bit, on relative frequencies of hashed byte
n-grams, says which half of the languages a text is in. Decoding weighs each bit by how well its classifier did on
the sample and takes the codeword with the least loss; a small lead over the next codeword flags ambiguity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, flat, slices, trimmed

#: Most labelled documents per language that the classifiers are fitted on.
PER_LANG = 350
DIM = 1 << 14
NGRAMS = (1, 2, 3)
AMBIGUOUS = 0.6
UND = "und"


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams that start at each byte, one array per n."""
    low = _LOWER[data].astype(np.uint32)
    h = np.zeros(len(low), np.uint32)
    for k in range(max(NGRAMS)):
        h = h[: len(low) - k] * np.uint32(0x01000193) + low[k:] + np.uint32(1 + k)
        if k + 1 in NGRAMS:
            x = h * np.uint32(0x9E3779B1)
            yield (x >> np.uint32(18)).astype(np.int32)
        if len(h) <= 1:
            break


def features(text: bytes) -> np.ndarray:
    """Root of the relative n-gram frequencies, of length 1."""
    out = np.zeros(DIM, np.float64)
    for g in _grams(np.frombuffer(text, np.uint8)):
        out += np.bincount(g, minlength=DIM)
    out = np.sqrt(out)
    return (out / max(1e-12, np.sqrt((out * out).sum()))).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1. Up to 6 languages: every split; more: the widest of seeded random codes."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    n, rng, best, wide = int(np.ceil(10 * np.log2(k))), np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (k, n))
        if (np.abs(m.sum(0)) == k).any():
            continue
        d = min(int((m[a] != m[b]).sum()) for a, b in itertools.combinations(range(k), 2))
        if d > wide:
            best, wide = m, d
    return best


def fit(sample: list[tuple[str, str]], rounds: int = 60) -> dict:
    """A model from (text, lang) rows; logistic loss, full-batch gradient steps with momentum."""
    langs = sorted({lang for _, lang in sample})
    code = codewords(len(langs))
    if len(langs) < 2:
        return {"langs": langs, "code": code, "w": np.zeros((DIM, 1), np.float32), "b": np.ones(1, np.float32), "weight": np.ones(1)}
    x = np.stack([features(t.encode()) for t, _ in sample])
    at = np.array([langs.index(lang) for _, lang in sample])
    share = 1 / np.bincount(at, minlength=len(langs))[at]
    share = (share / share.sum()).astype(np.float32)
    y = code[at].astype(np.float32)
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -(y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))) * share[:, None]
        vw = 0.9 * vw - 20 * (x.T @ g + 1e-6 * w)
        vb = 0.9 * vb - 2 * g.sum(0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == y) * share[:, None]).sum(0)
    return {"langs": langs, "code": code, "w": w, "b": b, "weight": np.maximum(right - 0.5, 1e-3) / np.maximum(right - 0.5, 1e-3).sum()}


def decode(model: dict, margin: np.ndarray) -> tuple[str, float]:
    """Language of the codeword with the least weighted logistic loss, and its share among all codewords."""
    loss = (np.log1p(np.exp(-np.clip(model["code"] * margin, -30, 30))) * model["weight"]).sum(1)
    p = np.exp(-4 * (loss - loss.min()))
    p /= p.sum()
    best = int(np.argmin(loss))
    return model["langs"][best], float(p[best])


def labels(col: pa.Array, model: dict) -> tuple[list[str], list[float]]:
    """Predicted language and score of each text of a column."""
    data, off = flat(col)
    lang, score = [UND] * len(col), [0.0] * len(col)
    if not model["langs"]:
        return lang, score
    for i, j in slices(off, 1 << 17):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        grams = list(zip(NGRAMS, _grams(part), strict=False)) if len(part) else []
        ascii_letter = ((part | 32) >= 97) & ((part | 32) <= 122)
        letters = np.concatenate([[0], np.cumsum(ascii_letter)])
        other = np.concatenate([[0], np.cumsum(part >= 128)])
        for k in range(j - i):
            s, e = o[k], o[k + 1]
            if letters[e] == letters[s] and (other[e] == other[s] or not any(c.isalpha() for c in part[s:e].tobytes().decode("utf-8", "replace"))):
                continue
            x = np.zeros(DIM)
            for n, g in grams:
                x += np.bincount(g[s : max(s, e - n + 1)], minlength=DIM)
            x = np.sqrt(x)
            x = (x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32)
            lang[i + k], score[i + k] = decode(model, x @ model["w"] + model["b"])
    return lang, score


def predict(df: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """`keep` columns with lang_pred, score, ambiguous (names after `prefix`). Null texts and texts without a letter: und, score 0."""
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = labels(b.column(0), model)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < AMBIGUOUS for s in score], pa.bool_())], [*keep, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(trimmed(run), f"{fields}, {names[0]} string, {names[1]} double, {names[2]} boolean")


def identified(df: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `df` in a language that the model tells: texts without a letter go, and those whose nearest codeword
    is ambiguous. A null in column `lang`, if there is one, gets the prediction; all else stays as it is."""
    at, to = df.columns.index(text), df.columns.index(lang) if lang in df.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, score = labels(b.column(at), model)
            cols = list(b.columns)
            if to >= 0:
                cols[to] = pc.coalesce(cols[to], pa.array(found, cols[to].type))
            keep = pa.array([x != UND and s >= AMBIGUOUS for x, s in zip(found, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(keep)

    return df.mapInArrow(trimmed(run), df.schema)


def learn(df: DataFrame, usable, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> dict:
    """Fit on at most `per_lang` documents of each language among the rows where `usable` holds.

    Rows are taken by hash of the key: counts per language first, then the share of hash values that gives about
    1.2 * per_lang rows, then the first per_lang of those. Nothing else of the corpus reaches the driver."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "") & usable)
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    u = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    want = F.lit(False)
    for k, c in n.items():
        want = want | ((F.col(lang) == k) & (u < 1.2 * per_lang / c))
    got: dict[str, list] = {}
    for r in rows.where(want).select(u.alias("u"), F.col(text).alias("t"), F.col(lang).alias("l")).toLocalIterator():
        got.setdefault(r.l, []).append((r.u, r.t))
        if len(got[r.l]) > 2 * per_lang:
            got[r.l] = sorted(got[r.l])[:per_lang]
    return fit([(t, k) for k in sorted(got) for _, t in sorted(got[k])[:per_lang]])


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for documents (doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2. Repeated rows give repeated rows; a null doc_id
    counts as learnable but has no held_out mark (false). With no learnable row every text is und."""
    out_fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs, ~out_fold, per_lang=per_lang)
    return predict(docs, model).select("doc_id", out_fold.alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the fitted model tells: those without text or letters go, and those whose decoding is
    ambiguous (score below AMBIGUOUS). A null lang becomes the predicted one.

    Where no row has a language and a text, there is no model and each text with a letter stays."""
    model = learn(docs, F.lit(True))
    return identified(docs, model) if model["langs"] else docs.where(F.col("text").rlike(r"\p{L}"))
