"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

File format: a folder of Parquet files that hold blocks, in ascending key order over files and rows. A block has
the keys and id counts of its documents, the id codes as one bit string, and the bit offset of every
`checkpoint`-th id, so that a reader starts at any of these places and decodes many of them at once by table.
Blocks don't depend on each other. A table of (id, code length) is all that a reader needs besides: canonical
codes follow from lengths.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import drop_durable, durable, flat, mix, prefix_hash, slices, small_batches, span_hash, trimmed

#: Longest code in bits; a table of 2**LIMIT entries decodes any code in one step.
LIMIT = 16
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
_MEMO = 1_000_000
_SLICE = 2 << 20
#: Bytes whose pieces are hashed at once: the arrays that this takes hold some fifty bytes for each.
_HASHED = 1 << 18
#: Byte-level pre-splitting always cuts before a blank, tab or line end that follows something else, and between a
#: letter or digit (ASCII, or Latin letter of lead byte C3) and one of the signs. Other white space and separators are
#: odd: a text that holds one is not cut.
_BLANK, _ALNUM, _SIGN, _ODD = (np.zeros(256, bool) for _ in range(4))
_BLANK[list(b" \n\r\t")] = True
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SIGN[list(b".,!?;:|*$%&#)")] = True
_ODD[[11, 12, 28, 29, 30, 31]] = True
_OTHER_BYTE = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_state: dict = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once per process; one thread each, as Spark runs a process per core."""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[path] = Tokenizer.from_file(path)
    return _state[path]


def width(path: str) -> str:
    """Stored type of an id: two bytes where the vocabulary allows it."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


class _Memo:
    """Ids of the pieces seen: sorted hashes, and where each piece's ids lie in one flat array."""

    def __init__(self, kind: str):
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(sizes) - sizes
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, sizes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size, self.ids = keys[order], at[order], size[order], np.concatenate([self.ids, ids])


def _odd(data: np.ndarray) -> np.ndarray:
    """Positions of white space or separators besides blank, tab and line ends."""
    out = _ODD[data]
    n = len(data)
    for lead, rest in ((0xC2, {(0x85,), (0xA0,)}), (0xE1, {(0x9A, 0x80)}), (0xE2, {(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {(0x81, 0x9F)}), (0xE3, {(0x80, 0x80)})):
        for i in np.flatnonzero(data == lead):
            out[i] = any(i + len(r) < n + 1 and tuple(data[i + 1 : i + 1 + len(r)].tolist()) == r for r in rest)
    return np.flatnonzero(out)


def _added(data: np.ndarray, path: str) -> list[int]:
    """Positions of the vocabulary's added tokens, which the library recognises in texts as well."""
    raw, out = data.tobytes(), []
    for token in tokenizer(path).get_added_tokens_decoder().values():
        name = token.content.encode()
        at = raw.find(name)
        while at >= 0:
            out.append(at)
            at = raw.find(name, at + 1)
    return out


def _pieces(data: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pieces of all texts of a flat buffer; a text with an added token isn't cut."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        blank = _BLANK[data]
        cut[1:] = blank[1:] & ~blank[:-1]
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= _SIGN[data[1:]] & letter[:-1]
        for d in np.unique(np.searchsorted(off, np.concatenate([_odd(data), np.array(_added(data, path), np.int64)]), "right") - 1):
            cut[off[d] : off[d + 1]] = False
        cut[off[:-1][np.diff(off) > 0]] = True
    s = np.flatnonzero(cut)
    return s, np.append(s[1:], n)


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the adjoining pieces s..e, a stretch of pieces at a time; a longer piece is a stretch of its own."""
    h, check = np.empty(len(s), np.uint64), np.empty(len(s), np.uint64)
    for i, j in slices(np.append(s, e[-1]), _HASHED):
        part, a, b = data[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i]
        h[i:j], check[i:j] = span_hash(prefix_hash(part), a, b), span_hash(prefix_hash(part, _OTHER_BYTE), a, b)
    return h, check


def encode_flat(path: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a flat buffer in their stored type, offsets of each text's ids), as the library gives them with
    add_special_tokens=False: nothing is put around a text, and an added token that stands in it gets its own id.

    Each text is cut where pre-splitting always cuts as well; the library encodes each distinct piece once, and a
    bounded memo keeps the ids of pieces seen. Pieces are told apart by a hash and checked by a second one."""
    tok, kind = tokenizer(path), width(path)
    s, e = _pieces(data, off, path)
    if not len(s):
        return np.zeros(0, kind), np.zeros(len(off), np.int64)
    h, check = _hashes(data, s, e)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (check[first][inverse] != check).any():
        keys, first, inverse = np.arange(len(h), dtype=np.uint64), np.arange(len(h)), np.arange(len(h))
        memo = _Memo(kind)
    else:
        keys = mix(keys ^ check[first])
        order = np.argsort(keys)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        keys, first, inverse = keys[order], first[order], back[inverse]
        memo = _state.setdefault((path, "memo"), _Memo(kind))
        if len(memo.keys) > _MEMO:
            memo = _state[path, "memo"] = _Memo(kind)
    there = np.minimum(np.searchsorted(memo.keys, keys), max(len(memo.keys) - 1, 0))
    new = np.flatnonzero(memo.keys[there] != keys) if len(memo.keys) else np.arange(len(keys))
    raw = data.tobytes()
    for i in range(0, len(new), 1 << 16):
        some = new[i : i + (1 << 16)]
        got = []
        for k in range(0, len(some), 2048):
            got += [x.ids for x in tok.encode_batch_fast([raw[a:b].decode() for a, b in zip(s[first[some[k : k + 2048]]].tolist(), e[first[some[k : k + 2048]]].tolist(), strict=True)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        memo.add(keys[some], sizes, np.fromiter(chain.from_iterable(got), kind, int(sizes.sum())))
    at = np.searchsorted(memo.keys, keys)[inverse]
    size = memo.size[at]
    end = np.cumsum(size)
    ids = memo.ids[np.repeat(memo.at[at] - end + size, size) + np.arange(end[-1])]
    return ids, np.concatenate([[0], end])[np.searchsorted(s, off)]


def tokenize(df: DataFrame, path: str, end: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_ids, ids): ids in the little-endian type `width` gives; `end` follows each text's ids unless None.

    Null counts as empty."""
    kind = width(path)
    tail = b"" if end is None else np.array([end], kind).tobytes()
    extra = 0 if end is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            for i, j in slices(off, _SLICE):
                ids, at = encode_flat(path, data[off[i] : off[j]], off[i : j + 1] - off[i])
                out = [ids[x:y].tobytes() + tail for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at) + extra), pa.array(out, pa.binary())], [key, "n_ids", "ids"])

    return df.select(key, text).mapInArrow(trimmed(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_ids long, ids binary")


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most `limit` bits for symbols with these counts (0: no code), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row, leaf = [], leaves, np.ones(len(leaves), bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packed])
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < len(leaves)
        levels.append(leaf)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by length, then value; code of each symbol) of the canonical code with these lengths."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in symbols:
        n = int(lengths[s])
        code <<= n - last
        codes[s], code, last = code, code + 1, n
    return symbols, codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each value of the next `limit` bits."""
    symbols, _ = canonical(lengths)
    reps = 1 << (limit - lengths[symbols])
    sym, n = np.repeat(symbols, reps).astype(np.uint32), np.repeat(lengths[symbols], reps)
    rest = (1 << limit) - len(sym)
    return np.concatenate([sym, np.zeros(rest, np.uint32)]), np.concatenate([n, np.ones(rest, np.int64)])


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
    """(bit string, bit offsets of each `every`-th id)."""
    n = lengths[ids]
    end = np.cumsum(n)
    at = end - n
    bits = int(end[-1]) if len(ids) else 0
    out = np.zeros((bits + 7) // 8 + 4, np.float64)
    word = codes[ids].astype(np.uint32) << (32 - n - (at & 7)).astype(np.uint32)
    byte = at >> 3
    for k in range(3):
        out += np.bincount(byte + k, (word >> np.uint32(24 - 8 * k)) & np.uint32(255), len(out))
    return out[: (bits + 7) // 8].astype(np.uint8).tobytes(), at[::every]


def unpack(bits: bytes, at: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray], every: int = CHECKPOINT, limit: int = LIMIT) -> np.ndarray:
    """The ids of a block: all checkpoints advance together, one table lookup each a step."""
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    sym, n = table
    pos = at.astype(np.int64).copy()
    out = np.zeros((len(pos), every), np.uint32)
    for k in range(min(every, n_ids)):
        v = (window[np.minimum(pos >> 3, len(window) - 1)] >> (32 - limit - (pos & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, k] = sym[v]
        pos += n[v]
    return out.reshape(-1)[:n_ids]


# ---------------------------------------------------------------- files


def counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs. One partial row per id and task, so the shuffle is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), kind)
            for i in range(0, len(ids), BLOCK_IDS):  # counting takes eight bytes an id
                c = np.bincount(ids[i : i + BLOCK_IDS])
                if len(c) < len(total):
                    c, total = total, c
                c = c.copy()
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def lengths_of(ids: DataFrame, kind: str, limit: int = LIMIT) -> np.ndarray:
    """Code length per id from the counts over all of `ids`. What reaches the driver is one row per vocabulary entry."""
    got = counts(ids, kind).collect()
    c = np.zeros(max([r.id for r in got], default=0) + 1, np.int64)
    for r in got:
        c[r.id] = r.n
    return code_lengths(c, limit)


def write(ids: DataFrame, kind: str, lengths: np.ndarray, path: str, key: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Write (key, ids) to `path` in ascending key order. A document never spans blocks; ties keep no order."""
    spark = ids.sparkSession
    _, codes = canonical(lengths)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(part: int, start: int, keys: list, sizes: list, data: list):
        all_ids = np.frombuffer(b"".join(data), kind)
        bits, at = pack(all_ids, lengths, codes)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
            ["part", "start", "keys", "sizes", "checkpoints", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held = TaskContext.get().partitionId(), 0, 0
        keys, sizes, data = [], [], []
        for b in batches:
            for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if keys and held + n > block_ids:
                    yield block(part, start, keys, sizes, data)
                    start, held, keys, sizes, data = start + held, 0, [], [], []
                keys.append(k)
                sizes.append(n)
                data.append(x)
                held += n
        if keys:
            yield block(part, start, keys, sizes, data)

    (
        ids.select(key, "n_ids", "ids")
        .repartitionByRange(parts, key)
        .sortWithinPartitions(key)
        .mapInArrow(trimmed(run), "part int, start long, keys array<long>, sizes array<long>, checkpoints array<long>, bits binary")
        .write.parquet(path)
    )


def read(spark: SparkSession, path: str, lengths: np.ndarray, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) per document of the files in `path`, decoded from the codes.

    start counts the ids of all documents before it. The only table that one task sees whole has a row per file."""
    blocks = spark.read.parquet(path)
    table = decode_table(lengths)
    total = blocks.groupBy("part").agg(F.max(F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("held"))
    from pyspark.sql import Window

    first = total.select(F.col("part").alias("p"), (F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, start, keys, sizes, at, bits = (c[i].as_py() for c in b.columns)
                sizes = np.array(sizes, np.int64)
                ids = unpack(bits, np.array(at, np.int64), int(sizes.sum()), table)
                end = np.cumsum(sizes)
                raw = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(end, sizes, strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(start + end - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([part] * len(keys), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if keep_ids else [])], [key, "at", "n_tokens", "ids_crc32", "part", *(["ids"] if keep_ids else [])])

    docs = blocks.select("part", "start", "keys", "sizes", "checkpoints", "bits").mapInArrow(trimmed(run), f"`{key}` long, at long, n_tokens long, ids_crc32 long, part int" + ", ids binary" * keep_ids)
    out = docs.join(F.broadcast(first), docs.part == first.p)
    return out.select(key, (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def round_trip(df: DataFrame, path: str, folder: str, end: int | None = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenize every text, write the ids as Huffman-coded files to `folder`, and read those back.

    Null and empty texts hold the end id only. Rows that share a key stay separate documents next to each other, in
    no fixed order; a null key sorts first. An empty table gives an empty folder and no rows. Memory follows the longest
    text, not the number of rows or partitions: workers see 1,000 texts and hash a stretch of them at a time, and give back
    what they held when a task ends."""
    small_batches(df.sparkSession, 1000)
    ids = durable(tokenize(df, path, end, text, key))
    kind = width(path)
    lengths = lengths_of(ids, kind)
    write(ids, kind, lengths, folder, key)
    drop_durable(ids)
    return read(df.sparkSession, folder, lengths, key)
