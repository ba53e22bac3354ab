"""Spelling variants of the corpus' words, by forward and reversed sorted dictionaries.

Two words one edit apart share, as the edit leaves a half intact, a prefix or a suffix of half the shorter one's length.
So the words stand in two dictionaries, sorted forward and from the end, and only words of one block, a range with a
common prefix or a common suffix, are compared. A block with more than MOST words is subdivided by the same rule: of
what is left between the shared ends, the edit leaves a half intact, so its words go to blocks with a longer shared
prefix and to blocks with a longer shared suffix. The smallest blocks have one code point between the shared ends, which
bounds them by the alphabet, not by the corpus. Every near pair stands in exactly one block, where the path of
subdivisions tells which pairs other blocks have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, fits_broadcast, flat, prefix_hash, slices, span_hash, trimmed

#: Words have so many code points and occurrences at least; a form occurs so many times as often as its variant.
MIN_SIZE, MIN_COUNT, RATIO = 5, 3, 2
#: A document's occurrences of a run lose a code point where this number divides the checksum of both.
MODULUS = 97
#: Words in a block that is scanned as it is.
MOST = 256
BROADCAST_BLOCKS = 500_000
_SLICE, _PAIRS = 1 << 21, 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # of the two bytes of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _checksums(low: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of runs of `low`, each after the bytes whose checksum is `state`."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    s, n, c = start[order], size[order], crc[order]
    long = int(np.searchsorted(-n, -64, "left"))
    for j in range(int(n[long]) if long < len(n) else 0):
        m = int(np.searchsorted(-n, -j, "left"))  # runs with more than j bytes
        c[long:m] = _CRC[(c[long:m] ^ low[s[long:m] + j]) & 255] ^ (c[long:m] >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for k in order[:long]:
        out[k] = zlib.crc32(low[start[k] : start[k] + size[k]].tobytes(), int(state[k]))
    return out


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of letters; they don't cross documents."""
    lead = data == _LEAD
    solid = _LETTER[data] | lead
    solid[1:] |= lead[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _counted(ids: list, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(words, occurrences) of the documents, those of fewer than MIN_SIZE code points left out."""
    low = _LOWER[data]
    s, e = _runs(data, off)
    doc = np.searchsorted(off, s, "right") - 1
    state = np.array([zlib.crc32(b"" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
    known = np.array([i is not None for i in ids], bool)
    cut = (_checksums(low, s, e - s, state[doc]) % MODULUS == 0) & known[doc]
    high = np.concatenate([[0], np.cumsum(data == _LEAD)])
    points = (e - s) - (high[e] - high[s])
    words, n = [], []
    keep = np.flatnonzero(~cut & (points >= MIN_SIZE))
    if len(keep):
        _, at, n = np.unique(span_hash(prefix_hash(low), s[keep], e[keep]), return_index=True, return_counts=True)
        raw = low.tobytes()
        words, n = [raw[a:b] for a, b in zip(s[keep[at]], e[keep[at]], strict=True)], list(n)
    for k in np.flatnonzero(cut & (points > MIN_SIZE)):
        run = low[s[k] : e[k]].tobytes()
        w = run.decode()
        j = zlib.crc32(run, int(state[doc[k]])) % len(w)
        words.append((w[:j] + w[j + 1 :]).encode())
        n.append(1)
    return words, np.array(n, np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text) as the contract of op13 takes them, whatever their n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (data, off) = b.column(0).to_pylist(), flat(b.column(1))
            for i, j in slices(off, _SLICE):
                words, n = _counted(ids[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i])
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(trimmed(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- blocks


def _ends(m: int, path: str) -> tuple[int, int, int]:
    """(prefix, suffix, cap) of a block: shared code points on either side, and the common prefix below which its pairs stay."""
    a, b, cap = 0, 0, m + 2
    for step in path:
        c = (m - a - b) // 2
        a, b, cap = (a + c, b, cap) if step == "p" else (a, b + c, min(cap, a + c))
    return a, b, cap


def _divided(entries: DataFrame) -> DataFrame:
    """Each entry (word, n, m, path, a, b) in its two smaller blocks: with a longer shared prefix, and with a longer shared suffix."""
    c = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    two = F.array(
        F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("a") + c).alias("a"), F.col("b").alias("b")),
        F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("a").alias("a"), (F.col("b") + c).alias("b")),
    )
    e = entries.select("word", "n", "m", F.explode(two).alias("x")).select("word", "n", "m", "x.*")
    size = F.char_length("word")
    return e.withColumn("head", F.col("word").substr(F.lit(1), F.col("a"))).withColumn("tail", F.reverse(F.col("word").substr(size - F.col("b") + 1, F.col("b"))))


KEY = ["m", "path", "head", "tail"]


def _blocks(words: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Saved tables of entries in blocks of at most MOST words or of the smallest kind, and what to drop once they are read."""
    size = F.char_length("word")
    both = F.explode(F.filter(F.array(size - 1, size), lambda m: m >= MIN_SIZE)).alias("m")
    whole = words.select("word", "n", both).select("*", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    entries, ready, spent = durable(_divided(whole)), [], []
    while True:
        spent.append(entries)
        large = durable(entries.where("m - a - b > 1").groupBy(*KEY).agg(F.count("*").alias("c")).where(F.col("c") > MOST).drop("c"))
        spent.append(large)
        if large.isEmpty():
            return [*ready, entries], spent
        keys = F.broadcast(large) if fits_broadcast(large, BROADCAST_BLOCKS) else large
        ready.append(entries.join(keys, KEY, "left_anti"))
        entries = durable(_divided(entries.join(keys, KEY, "left_semi")))


def _near(x: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, m: int, cap: int) -> np.ndarray:
    """Which pairs (i, j) of rows of `x` (code points, padded) are one edit apart, have a common prefix shorter than `cap`,
    and a shorter word of m code points."""
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    a, b, longer = x[i], x[j], size[j] > m
    same = a[:, :m] == b[:, :m]
    first = np.where(same.all(1), m, same.argmin(1))
    replaced = same.sum(1) == m - 1
    back = a[:, :m] == b[:, 1 : m + 1]
    after = np.where(back.all(1), m, back[:, ::-1].argmin(1))
    return (size[i] == m) & (first < cap) & np.where(longer, first + after >= m, replaced)


def _pairs_of(words: list[str], m: int, cap: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near words within the blocks of `words` that begin at `starts`."""
    size = np.array([len(w) for w in words])
    x = np.frombuffer(b"".join(w.encode("latin-1").ljust(m + 1, b"\0") for w in words), np.uint8).reshape(-1, m + 1)
    end = np.repeat(np.append(starts[1:], len(words)), np.diff(np.append(starts, len(words))))
    rest = end - np.arange(len(words)) - 1
    i = 0
    while i < len(words):
        k = max(i + 1, int(np.searchsorted(np.cumsum(rest[i:]), _PAIRS, "right")) + i)
        r = rest[i:k]
        if r.sum():
            left = np.repeat(np.arange(i, i + len(r)), r)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
            good = _near(x, size, left, right, m, cap)
            if good.any():
                yield left[good], right[good]
        i = k


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of entries sorted by block; a block that a batch cuts goes on in the next one."""

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        changes = [pc.not_equal(t[c].slice(1), t[c].slice(0, len(t) - 1)).to_numpy() for c in KEY]
        new = np.concatenate([[True], np.logical_or.reduce(changes)])
        kind = np.concatenate([[True], np.logical_or.reduce(changes[:2])])
        words, n, m, path = t["word"].to_pylist(), t["n"].to_numpy(), t["m"].to_numpy(), t["path"]
        cuts = np.append(np.flatnonzero(kind), len(t))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            _, _, cap = _ends(int(m[lo]), path[int(lo)].as_py())
            for i, j in _pairs_of(words[lo:hi], int(m[lo]), cap, np.flatnonzero(new[lo:hi])):
                i, j = np.concatenate([i, j]) + lo, np.concatenate([j, i]) + lo
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i]), pa.array([words[k] for k in j]), pa.array(n[j])], ["word", "near", "near_n"])

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not len(t):
            continue
        last = [t[c][-1].as_py() for c in KEY]
        open_ = np.logical_and.reduce([pc.equal(t[c], v).to_numpy() for c, v in zip(KEY, last, strict=True)])
        cut = len(t) - int(open_.sum())  # the last block's rows stand together at the end
        if cut:
            yield from found(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield from found(held)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for each two of `words` (word, n; saved) one edit apart, both ways, as a saved table."""
    parts, spent = _blocks(words)
    entries = parts[0].select("word", "n", *KEY)
    for p in parts[1:]:
        entries = entries.unionByName(p.select("word", "n", *KEY))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = entries.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY, "word")
    out = durable(ranges.mapInArrow(trimmed(_scan), "word string, near string, near_n long"))
    drop_durable(*spent)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of saved (word, form): forms are followed to the last one, twice as far each round."""
    to = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_durable(to)
        to = step
        if to.where("moved").isEmpty():
            return to.select("word", "root")


def variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: Column | int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `docs` (doc_id, text); see word_counts().

    Null and empty texts have no words; repeated rows count as often as they occur; where doc_id is null nothing is
    deleted from a run. Texts are taken whole, in slices between documents."""
    words = durable(word_counts(docs).where((F.char_length("word") >= MIN_SIZE) & (F.col("n") >= min_count)))
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("x"))
    is_form = -F.col("x.less") >= ratio * F.col("n")
    got = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("x.near")).alias("form"), F.when(is_form, -F.col("x.less")).alias("form_n")))
    drop_durable(pairs, words)
    roots = _roots(got.where("form IS NOT NULL"))
    return got.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
