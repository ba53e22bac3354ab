"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of `length` bytes is found by one suffix: the one that starts at its anchor, the position of the smallest
hashed 16-gram in the first part of the string. The anchor depends on the string alone, so equal strings have
equal anchors, and only suffixes at anchors (about one in a hundred) enter the arrays.

A suffix array is a table of suffixes in the order of their first eight bytes, and among equal ones in the order of a
hash of the bytes that all strings with this anchor hold: beyond eight bytes the order is not that of the text, but
suffixes with a long common beginning, the only ones that matter, are neighbours all the same. Each new batch of
documents gets a suffix array, is merge-scanned (a sort-merge join) against the existing levels for such neighbours,
and becomes a level itself; levels of equal size merge, so there are as many levels as the number of batches has
binary ones. `Family` keeps its levels in a folder, so batches can be added by later runs. Suffixes that meet again
are compared in full: first the bytes of all strings of an anchor at once, then of stretches of 16 strings, and single
strings only where a stretch neither repeats as a whole nor is ruled out by what its strings share.

What the search shuffles is hashes and positions; whole texts move only for documents with an open stretch and, once,
with the ranges to remove. Copies, however many, are counted before they are shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_durable, durable, flat, mix, powers, prefix_hash, shared_dir, slices, small_batches, span_hash, trimmed, words

LENGTH, GRAM, WINDOW, STRETCH, BATCHES = 400, 16, 200, 16, 4
PASSAGE, PASSAGE_WINDOW, WORD_GRAM = 50, 32, 4
_U = np.uint64


def _chosen(h: np.ndarray, off: np.ndarray, length: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, p, lo, hi) of each anchor, given the prefix hash of bytes or words: positions of the whole buffer."""
    sizes = np.diff(off)
    keep = sizes >= length
    if not keep.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(len(h) - gram)
    low, reach = span_hash(h, at, at + gram) & _U(0xFFFFFFFF00000000) | at.astype(np.uint64), 1
    while reach * 2 <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < window:
        low = np.minimum(low[: len(low) - (window - reach)], low[window - reach :])
    first = off[:-1][keep]
    many = (sizes - length + 1)[keep]
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    p = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(p)) - 1
    p, lo, hi = p[a], starts[a], starts[b]
    return np.searchsorted(off, lo, "right") - 1, p, lo, hi


def _hashes(h: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, full) of anchors: hashes of what all strings from p on, and any string, of an anchor hold."""
    full = mix(span_hash(h, lo, hi + length) + (p - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return span_hash(h, p, p + (length - window + 1)), full


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, p, lo, hi, head, key, full): strings starting at lo..hi have anchor p; positions within the document.

    head: eight bytes at p, big-endian; key: hash of the bytes from p on that all these strings hold; full: hash of
    all bytes of these strings."""
    h = prefix_hash(data)
    doc, p, lo, hi = _chosen(h, off, length, window, GRAM)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    key, full = _hashes(h, p, lo, hi, length, window)
    head = np.zeros(len(p), np.uint64)
    for k in range(8):
        head = head << _U(8) | data[p + k].astype(np.uint64)
    base = off[doc]
    return doc, p - base, lo - base, hi - base, head, key, full


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def suffixes(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(row, p, before, more, head, key, full) of every anchor of the texts: lo = p - before, hi = lo + more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            rows = np.asarray(b.column(0))
            for i, j in slices(off):
                doc, p, lo, hi, head, key, full = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], length, window)
                if len(p):
                    cols = [_long(rows[i + doc]), _long(p), pa.array((p - lo).astype(np.int16)), pa.array((hi - lo).astype(np.int16)), _long(head ^ _U(1 << 63)), _long(key), _long(full)]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "p", "before", "more", "head", "key", "full"])

    return docs.select("row", "text").mapInArrow(trimmed(run), "row long, p long, before short, more short, head long, key long, full long")


class Family:
    """Suffix arrays whose sizes double: a level of rank r holds 2**r batches.

    The levels are tables in the folder `path`. The last of its files `levels-NUMBER` names the current ones; a new one
    appears in one step after its tables are written, so a run that breaks off leaves the family as it was."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.levels: list[tuple[int, str]] = []
        self.batches: list[str] = []
        self._fs.mkdirs(self._path(path))
        self.number = max([int(n.split("-")[1]) for n in self._names() if re.fullmatch("levels-[0-9]+", n)], default=0)
        if self.number:
            lines = [r.value.split(" ") for r in spark.read.text(f"{path}/levels-{self.number}").collect()]
            self.levels = sorted(((int(r), name) for r, name in lines if r != "batch"), reverse=True)
            self.batches = [name for r, name in lines if r == "batch"]

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema("head long, key long, n long").parquet(f"{self.path}/{name}")

    def _keep(self, levels: list[tuple[int, str]]) -> None:
        out = self._fs.create(self._path(f"{self.path}/new"), True)
        out.write("\n".join([f"{r} {name}" for r, name in levels] + [f"batch {name}" for name in self.batches]).encode())
        out.close()
        self._fs.rename(self._path(f"{self.path}/new"), self._path(f"{self.path}/levels-{self.number + 1}"))
        self._fs.delete(self._path(f"{self.path}/levels-{self.number}"), False)
        self.number += 1
        gone = {name for _, name in self.levels} - {name for _, name in levels}
        self.levels = levels
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _written(self, array: DataFrame) -> str:
        name = f"level-{uuid.uuid4().hex}"
        array.groupBy("head", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("head", "key").write.parquet(f"{self.path}/{name}")
        return name

    def side(self, kind: str, schema: str) -> DataFrame:
        """The side tables of one kind of all batches, as one."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}-{b}" for b in self.batches])

    def add(self, array: DataFrame, last: bool = False, sides: dict[str, DataFrame] | None = None) -> DataFrame:
        """Merge-scan a batch (head, key, n) against all levels, insert it, and return the suffixes met (head, key).

        The `last` batch of a family that is thrown away afterwards isn't merged. `sides` are tables kept with the batch,
        beside the suffixes met; they appear together with it."""
        rank, name = 0, self._written(array)
        mine = self.level(name)
        met = mine.where("n > 1").select("head", "key")
        for _, other in self.levels:
            met = met.unionByName(mine.hint("merge").join(self.level(other).select("head", "key"), ["head", "key"]).select("head", "key"))
        met = durable(met.distinct())
        if sides is not None:
            batch = uuid.uuid4().hex
            for kind, table in (sides | {"met": met}).items():
                table.write.parquet(f"{self.path}/{kind}-{batch}")
            self.batches = [*self.batches, batch]
        levels, own = list(self.levels), [name]
        while not last and levels and levels[-1][0] == rank:
            _, other = levels.pop()
            rank, name = rank + 1, self._written(self.level(name).unionByName(self.level(other)))
            own.append(name)
        self._keep([*levels, (rank, name)])
        for x in own[:-1]:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return met

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)


def array_of(found: DataFrame) -> DataFrame:
    """(head, key, n): the suffix array of the anchors of suffixes()."""
    return found.groupBy("head", "key").agg(F.count("*").alias("n"))


def repeated(found: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(key) of suffixes that occur at two places or more, by adding `found` to a family in `batches` batches."""
    family, met = Family(found.sparkSession, f"{shared_dir(found.sparkSession)}/family-{uuid.uuid4().hex}"), []
    for k in range(batches):
        batch = found.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == k)
        met.append(family.add(array_of(batch), last=k == batches - 1))
    out = durable(functools.reduce(DataFrame.unionByName, met).select("key").distinct())
    drop_durable(*met)
    family.drop()
    return out


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(row, own, i, outer, core, singles) for stretches of strings of the anchors listed in column `at` of `docs`.

    i: start of the first string of the part that belongs to the anchor; outer / core: hash of the bytes that any / all
    strings of the whole stretch hold (outer null if the document ends before); singles: hashes of the part's strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            out: list[list] = [[], [], [], [], [], []]
            for k, (row, lists) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                text = data[off[k] : off[k + 1]]
                h = prefix_hash(text)
                p = np.array([x["p"] for x in lists], np.int64)
                before = np.array([x["before"] for x in lists], np.int64)
                more = np.array([x["more"] for x in lists], np.int64)
                own = np.array([x["own"] for x in lists], bool)
                first, final = (before - more) // STRETCH, before // STRETCH
                which = np.repeat(np.arange(len(p)), final - first + 1)
                j = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, final, strict=True)])
                q = p[which]
                wide_s, wide_e = q - STRETCH * j - STRETCH + 1, q - STRETCH * j + length
                fits = (wide_s >= 0) & (wide_e <= len(text))
                outer = span_hash(h, np.where(fits, wide_s, 0), np.where(fits, wide_e, 0)) + (j * 2).astype(np.uint64)
                core = span_hash(h, q - STRETCH * j, q - STRETCH * j - STRETCH + 1 + length) + (j * 2 + 1).astype(np.uint64)
                lo = np.maximum(q - STRETCH * j - STRETCH + 1, q - before[which])
                hi = np.minimum(q - STRETCH * j, q - before[which] + more[which])
                n = hi - lo + 1
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                single = span_hash(h, at, at + length).view(np.int64)
                cut = np.concatenate([[0], np.cumsum(n)])
                out[0] += [row] * len(q)
                out[1] += own[which].tolist()
                out[2] += lo.tolist()
                out[3] += [x if f else None for x, f in zip(outer.view(np.int64).tolist(), fits, strict=True)]
                out[4] += core.view(np.int64).tolist()
                out[5] += [single[cut[x] : cut[x + 1]] for x in range(len(n))]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["row", "own", "i", "outer", "core", "singles"])

    return docs.select("row", "text", "at").mapInArrow(trimmed(run), "row long, own boolean, i long, outer long, core long, singles array<long>")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(row, lo, hi): ranges of starts of strings that occur elsewhere, as many as repeated stretches at most. `docs` has row (a key) and text."""
    found = durable(suffixes(docs, length, window))
    again = repeated(found, batches)
    cand = durable(found.select(*ENTRY).join(again, "key"))
    drop_durable(found)
    out = _ranges(docs, cand, length)
    drop_durable(again, cand)
    return out


ENTRY = ("row", "p", "before", "more", "key", "full")


def _ranges(docs: DataFrame, cand: DataFrame, length: int) -> DataFrame:
    """(row, lo, hi) from saved anchors that share their key with another one, all anchors of a key together."""
    # Anchors whose strings all repeat together; one of each such group stands for it below.
    groups = durable(cand.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "before", "more")).alias("x")))
    whole = cand.join(groups.where("n > 1").select("key", "full"), ["key", "full"], "left_semi")
    whole = whole.select("row", (F.col("p") - F.col("before")).alias("lo"), (F.col("p") - F.col("before") + F.col("more")).alias("hi"))
    open_keys = groups.groupBy("key").agg(F.count("*").alias("g"), F.min("n").alias("least")).where("g > 1 AND least = 1").select("key")
    listed = durable(groups.join(open_keys, "key").select("x.row", F.struct("x.p", "x.before", "x.more", (F.col("n") == 1).alias("own")).alias("a")).groupBy("row").agg(F.collect_list("a").alias("at")))
    parts = durable(_stretches(docs.join(listed, "row"), length))
    twice = lambda c: parts.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("c")).where("c > 1").select(c)
    alive = parts.join(twice("core"), "core", "left_semi")
    outer = twice("outer").select(F.col("outer").alias("o"))
    alive = durable(alive.join(outer, alive.outer == outer.o, "left").select("row", "own", "i", "singles", F.col("o").isNotNull().alias("all")))
    drop_durable(parts)
    together = alive.where("own AND all").select("row", F.col("i").alias("lo"), (F.col("i") + F.size("singles") - 1).alias("hi"))
    # A string may also equal one whose stretch repeats as a whole, so all living stretches give their strings.
    single = alive.select("row", "own", "all", "i", F.posexplode("singles").alias("k", "s"))
    seen = single.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    alone = single.where("own AND NOT all").join(seen, "s", "left_semi").groupBy("row", "i").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    # neighbouring strings of a stretch become one range; a stretch has 16 at most
    first = F.filter("ks", lambda k: ~F.array_contains("ks", k - 1))
    last = F.filter("ks", lambda k: ~F.array_contains("ks", k + 1))
    alone = alone.select("row", "i", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("x")).select("row", (F.col("i") + F.col("x.a")).alias("lo"), (F.col("i") + F.col("x.b")).alias("hi"))
    out = durable(whole.unionByName(together).unionByName(alone))
    drop_durable(groups, listed, alive)
    return out


def extend(new: DataFrame, path: str, length: int = LENGTH, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """dedup() of a batch of documents against all batches that earlier runs left in the family at `path`, which takes the batch.

    The rows of `new`, and those earlier rows that a string of the new batch may repeat: their results replace the earlier
    ones. So the last result of each row, over all runs, is what one run over all batches gives. Beside its suffix arrays
    the family keeps the batches' texts, anchors, and suffixes met; of them a run reads the keys and rows concerned."""
    small_batches(new.sparkSession, 1000)
    family = Family(new.sparkSession, path)
    kind = new.schema[key].dataType.simpleString()
    rows = durable(new.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text", "id")))
    found = durable(suffixes(rows.select("row", "text"), length, window))
    met = family.add(array_of(found), sides={"texts": rows, "anchors": found.select(*ENTRY)})
    drop_durable(found)
    texts, anchored = family.side("texts", f"id {kind}, text string, row long"), family.side("anchors", "row long, p long, before short, more short, key long, full long")
    ever = family.side("met", "head long, key long").select("key").distinct()
    moved = durable(anchored.join(met.select("key").distinct(), "key", "left_semi").select("row").unionByName(rows.select("row")).distinct())
    keys = anchored.join(moved, "row", "left_semi").select("key").distinct().join(ever, "key", "left_semi")
    cand = durable(anchored.join(keys, "key", "left_semi"))
    # Rows that occur twice have their anchors twice but are one text.
    lists = _ranges(texts.select("row", "text").dropDuplicates(["row"]), cand, length).join(moved, "row", "left_semi").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = texts.join(moved, "row", "left_semi").join(lists, "row", "left").select("id", "text", "ranges")
    out = durable(_without(joined, length, key, kind, keep_text))
    drop_durable(rows, met, moved, cand)
    return out


def _word_sums(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hash of the words of all texts of a flat buffer, offsets of each text's words)."""
    w, _, d = words(data, off)
    h = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(len(w) + 1)[0][: len(w)], out=h[1:])
    return h, np.searchsorted(d, np.arange(len(off)))


def shared_words(docs: DataFrame, length: int = PASSAGE, window: int = PASSAGE_WINDOW) -> DataFrame:
    """(row, n_shared_words): words within runs of `length` words that another row of `docs` (row, text) holds as well.

    Words are those of op7, A-Z lower-cased; rows without such words are left out. The search is that of the bytes, over
    words: anchors that meet in another row, all strings of an anchor at once where these are the same, else one by one."""

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            rows = np.asarray(b.column(0))
            for i, j in slices(off):
                h, at = _word_sums(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, p, lo, hi = _chosen(h, at, length, window, WORD_GRAM)
                if len(p):
                    key, full = _hashes(h, p, lo, hi, length, window)
                    cols = [_long(rows[i + doc]), pa.array((lo - at[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int16)), _long(key), _long(full)]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "lo", "more", "key", "full"])

    def singles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(1))
            for k, (row, listed) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                h, _ = _word_sums(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))
                lo = np.array([x["lo"] for x in listed], np.int64)
                n = np.array([x["more"] for x in listed], np.int64) + 1
                i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                own = np.repeat(np.array([x["own"] for x in listed], bool), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row)), pa.array(own), pa.array(i.astype(np.int32)), _long(span_hash(h, i, i + length))], ["row", "own", "i", "s"])

    found = durable(docs.select("row", "text").mapInArrow(trimmed(found_in), "row long, lo int, more short, key long, full long"))
    # Joined with saved tables, so that the rows of a very frequent key can be split over tasks.
    met = durable(found.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("key"))
    cand = durable(found.join(met, "key", "left_semi"))
    drop_durable(found)
    groups = durable(cand.groupBy("key", "full").agg(F.min(F.struct("row", "lo", "more")).alias("x"), F.max("row").alias("b")))
    apart = groups.where("x.row = b")
    whole = cand.join(groups.where("x.row < b").select("key", "full"), ["key", "full"], "left_semi").select("row", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    # Strings that the documents of a key don't hold all together are compared with each other, and with one of each group that several rows hold.
    lone = cand.join(apart.select("key", "full"), ["key", "full"], "left_semi").select("row", "lo", "more", F.lit(True).alias("own"))
    one = groups.where("x.row < b").join(apart.select("key").distinct(), "key", "left_semi").select("x.row", "x.lo", "x.more", F.lit(False).alias("own"))
    listed = lone.unionByName(one).groupBy("row").agg(F.collect_list(F.struct("lo", "more", "own")).alias("at"))
    singles = durable(docs.join(listed, "row").select("row", "text", "at").mapInArrow(trimmed(singles_in), "row long, own boolean, i int, s long"))
    again = durable(singles.groupBy("s").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.bool_and("own").alias("own")).where("a < b OR NOT own").select("s"))
    alone = singles.where("own").join(again, "s", "left_semi").select("row", F.col("i").alias("lo"), F.col("i").alias("hi"))
    ranges = whole.unionByName(alone).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def joined(a, x):
        end = F.greatest(a["end"], x["hi"] + length)
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], x["lo"])).cast("long").alias("n"))

    out = durable(ranges.select("row", F.aggregate("r", none, joined, lambda a: a["n"]).alias("n_shared_words")))
    drop_durable(met, cand, groups, singles, again)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES, key: str = "doc_id", text: str = "text", keep_text: bool = False, passage: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row.

    Null texts count as empty and texts shorter than `length` bytes keep all. Repeated rows are documents of their
    own, so each of them repeats the other. With `passage`, n_shared_words follows: how many of the row's words stand in
    a run of that many words that a row with another key or text holds as well. These are only counted, not removed."""
    small_batches(docs.sparkSession, 1000)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text", "id"))
    ranges = repeated_ranges(rows.select("row", "text"), length, window, batches)
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(lists, "row", "left")
    if passage is not None:
        joined = joined.join(shared_words(rows.select("row", "text"), passage), "row", "left").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0).cast("long")))
    return _without(joined.select("id", "text", "ranges", *["n_shared_words"] * (passage is not None)), length, key, docs.schema[key].dataType.simpleString(), keep_text)


def _without(joined: DataFrame, length: int, key: str, kind: str, keep_text: bool) -> DataFrame:
    """The report of dedup() from id, text and ranges of starts. Further columns, all long, follow."""
    more = joined.columns[3:]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            data, off = flat(b.column(1))
            size, gone, spans, sha, left = [], [], [], [], []
            for k, got in enumerate(b.column(2).to_pylist()):
                body = data[off[k] : off[k + 1]]
                keep = body
                n = 0
                if got:
                    step = np.zeros(len(body) + 1, np.int64)
                    np.add.at(step, [x["lo"] for x in got], 1)
                    np.add.at(step, [x["hi"] + length for x in got], -1)
                    dead = np.cumsum(step)[:-1] > 0
                    n = int((dead[1:] & ~dead[:-1]).sum() + dead[0])
                    keep = body[~dead]
                raw = keep.tobytes()
                size.append(len(body))
                gone.append(len(body) - len(raw))
                spans.append(n)
                sha.append(hashlib.sha256(raw).hexdigest())
                left.append(raw)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(left, pa.binary())] if keep_text else []), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []), *more])

    return joined.mapInArrow(trimmed(run), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text + "".join(f", {c} long" for c in more))
