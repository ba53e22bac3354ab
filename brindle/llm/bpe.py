"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are encoded one by one inside Arrow batches. A long text is first cut at safe boundaries: between a
character that is no white space and a blank or line feed. No match of the pre-splitting pattern spans such a place (a
match holds white space only at its start, or is white space throughout), so each piece gives the ids it gives
within the whole text, and no call sees more than `piece` characters plus one run without a boundary.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
_cached: dict = {}


def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token, rank), once per process."""
    if (path, pattern) not in _cached:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cached[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _cached[path, pattern]


def pieces(text: str, piece: int = _PIECE) -> Iterator[str]:
    """Cut `text` at the first safe boundary after every `piece` characters."""
    at = 0
    while len(text) - at > piece:
        m = _BOUNDARY.search(text, at + piece)
        if not m or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(enc: tiktoken.Encoding, text: str, piece: int = _PIECE) -> list[int]:
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text, piece):
        ids += enc.encode_ordinary(part)
    return ids


def encode_column(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids", piece: int = _PIECE) -> DataFrame:
    """`df` with the ids of `text` as array<int>. A null text counts as empty (no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for b in batches:
            ids = [encode(enc, t or "", piece) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(i) for i, f in enumerate(b.schema) if f.name != out]
            names = [f.name for f in b.schema if f.name != out]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    kept = [c for c in df.schema if c.name != out]
    return df.mapInArrow(run, df.select(*[c.name for c in kept]).withColumn(out, F.array().cast("array<int>")).schema)


def decode_column(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the raw bytes that `ids` stand for. They need not be valid UTF-8; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            cols = [b.column(i) for i, f in enumerate(b.schema) if f.name != out]
            names = [f.name for f in b.schema if f.name != out]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())], [*names, out])

    kept = [c.name for c in df.schema if c.name != out]
    return df.mapInArrow(run, df.select(*kept).withColumn(out, F.lit(b"")).schema)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", piece: int = _PIECE) -> DataFrame:
    """One row per row of `df`: key, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Encodes, then decodes the ids, in one pass and without holding the ids of more than one text. Null and empty
    texts have no ids. Repeated rows give repeated rows; a null key stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for b in batches:
            n, a, c, size = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = encode(enc, t or "", piece)
                raw = enc.decode_bytes(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                c.append(hashlib.sha256(raw).hexdigest())
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(c), pa.array(size, pa.int64())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def tokens(df: DataFrame, ranks: str, pattern: str, text: str = "text", piece: int = _PIECE) -> DataFrame:
    """`df` without `text`, with ids (array<int>), n_tokens and whole (the ids decode to the text's bytes). Null counts as empty.

    Columns of `df` with one of these names, in any case, give way to the new ones."""
    keep = [c for c in df.columns if c != text and c.lower() not in ("ids", "n_tokens", "whole")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                texts = [t or "" for t in b.column(len(keep)).to_pylist()]
                ids = [encode(enc, t, piece) for t in texts]
                whole = [enc.decode_bytes(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, off[-1])
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists, pa.array(np.diff(off).astype(np.int64)), pa.array(whole, pa.bool_())], [*keep, "ids", "n_tokens", "whole"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}, ids array<int>, n_tokens long, whole boolean")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's columns but the text, with its ids, n_tokens, and whether they decode to the text."""
    import public_tokenizers

    return tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
