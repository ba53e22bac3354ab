"""Shared pieces of the training-data operators: table reads, durable tables and vectorised text hashing.

The hashing helpers work on one flat byte buffer for many documents, so numpy sees long arrays instead of
short strings. Word hashes and shingle hashes depend on the words only, never on the batch they came in.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import drop_saved as drop_durable  # noqa: F401
from ..operators.components import saved, shared_dir  # noqa: F401

_U = np.uint64
_MAX_SLICE = 1 << 19


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; further columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def durable(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder; the shuffle files behind it go."""
    return saved(df, tidy=True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's Arrow batch size to `rows` if it is larger: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a durable table has at most `rows` rows; the caller broadcasts it only then."""
    return df.limit(rows + 1).count() <= rows


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(run):
    """`run` (a function of Arrow batches) that gives back what allocators hold when a task ends: Spark keeps Python
    workers for later tasks, and their memory counts while those of other stages run."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


# ---------------------------------------------------------------- flat buffers


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = _MAX_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` bytes each; a longer document is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE = (_BASE & ~7) | 5  # 5 mod 8: powers repeat only after 2**62 steps
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POW["p"]) <= n:
        m = max(n + 1, 2 * len(_POW["p"]), 1 << 16)
        for k, b in (("p", _BASE), ("q", _INV)):
            a = np.full(m, _U(b), np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _POW[k] = a
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """H with hash of data[s:e] = (H[e] - H[s]) * inverse**s (see span_hash)."""
    p, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(table[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, q = powers(len(h))
    return mix((h[e] - h[s]) * q[s] + (e - s).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte start, document) of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    w = span_hash(prefix_hash(_LOWER[data]), s, e)
    return w, s, np.searchsorted(off, s, "right") - 1


_MULT = [_U(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(w: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `size` words; a document with fewer words has its whole sequence as one.

    `counts` are the words of each document in order. Documents without words have no shingle."""
    n_docs = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    m = np.maximum(counts - size + 1, 0)
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= size:
        acc = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            acc += mix(w[k : len(w) - size + 1 + k] + _MULT[k % 5]) * _MULT[(k + 1) % 5]
        at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(m)])[:-1], m) + np.arange(m.sum())
        h, d = mix(acc[at]), np.repeat(np.arange(n_docs), m)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        with np.errstate(over="ignore"):
            one = []
            for i in short:
                x = _U(int(counts[i]) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                for v in w[first[i] : first[i + 1]]:
                    x = mix(np.array([x * _U(0x2545F4914F6CDD1D) + v], np.uint64))[0]
                one.append(x)
        h, d = np.concatenate([h, np.array(one, np.uint64)]), np.concatenate([d, short])
    return h, d


def doc_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(document, sorted distinct shingle hashes) for each document of the buffer."""
    n = len(off) - 1
    for i, j in slices(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        w, _, d = words(part, o)
        h, hd = shingles(w, np.bincount(d, minlength=j - i), size)
        if len(hd) and (np.diff(hd) < 0).any():
            order = np.argsort(hd, kind="stable")
            h, hd = h[order], hd[order]
        cut = np.searchsorted(hd, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(h[cut[k] : cut[k + 1]])
    assert n >= 0


def text_id(doc_id, text):
    """A key that tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), doc_id)
