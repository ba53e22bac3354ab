"""Jaccard join on word 5-grams with a token-group matrix.

Exact: two documents get one component where a chain of pairs with a Jaccard similarity of at least `percent` per
cent leads from one to the other. `links` gives pairs that connect all of them; pairs that lie within what is
connected already are not listed.

1. Sets. Each text becomes the set of its shingle hashes; equal sets count as one from then on. Every set gives its
   prefix: the n - ceil(t n) + 1 first tokens in an order that puts frequent tokens last, rarest first. Similar
   sets share a prefix token, and its places in both bound what they can have in common.
2. Groups. Each prefix token has a leader, and each set joins the leader that most of its tokens name. Sets that
   turn out similar to their leader form a group of linked sets with it; the others of a leader form a loose group.
3. Matrix. A group's row is the union of its members' prefix tokens with the range of their sizes. The tokens that a
   set of another component shares with the row bound its intersection with every member; only a group whose bound
   allows the threshold is opened. Groups lie in blocks of bounded size, and opened groups are compared block with
   block by products of token matrices, first of shared prefix tokens alone, then of whole sets for members that
   still have a possible partner, so pairs are never rows of a table.

No group is gathered: leaders, votes and rows are aggregated before they are shuffled, joins can be split, and a
block has at most about MEMBERS sets or TOKENS tokens (a longer text is a block of its own). Sets that are similar
to no leader but lie close together are all compared with each other, which is quadratic in such a region, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import doc_sets, drop_durable, durable, fits_broadcast, flat, fresh, mix, small_batches, trimmed

PERCENT = 80
#: Most tokens in the list of frequent ones (it only orders tokens; any list gives the same links), and how often a
#: token must occur in all to enter it.
FREQUENT, OFTEN = 200_000, 24
BROADCAST_ROWS = 2_000_000
#: About as many sets and tokens a block of a group holds.
MEMBERS, TOKENS = 128, 65_536
_U = np.uint64


def _signature(s: np.ndarray) -> int:
    """A hash of a set, independent of order; 0 only for the empty set."""
    if not len(s):
        return 0
    x = mix(s + _U(0x1234567)).sum(dtype=np.uint64) ^ _U(len(s))
    v = int(mix(np.array([x], np.uint64)).view(np.int64)[0])
    return v or 1


def frequent_tokens(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Up to FREQUENT tokens that occur in OFTEN sets or more, as found from counts within batches of documents, sorted,
    and the place of each in the order of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, held = set(), [], 0

        def out():
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            many = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["h", "n"])

        for b in batches:
            data, off = flat(b.column(0))
            for _, s in doc_sets(data, off):
                sig = _signature(s)
                if len(s) and sig not in seen:
                    seen.add(sig)
                    sets.append(s)
                    held += len(s)
                    if held > 2_000_000:
                        yield out()
                        seen, sets, held = set(), [], 0
        if sets:
            yield out()

    rows = docs.select(text).mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = rows.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(top)
    return top[order], (len(top) - 1 - order).astype(np.int32)


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """The first tokens of a set, and how many of them are not in the list of frequent ones."""
    n = len(s)
    take = n - -(-n * percent // 100) + 1
    tokens, place = frequent
    if not len(tokens):
        return s[:take], take
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    often = tokens[at] == s
    rare = s[~often]
    if len(rare) >= take:
        return rare[:take], take
    return np.concatenate([rare, s[often][np.argsort(place[at[often]])]])[:take], len(rare)


def documents(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(id, row, n, sig, prefix, rare) of `docs` (id, row, text): a set that occurred before in the same task has no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for b in batches:
            data, off = flat(b.column(2))
            if len(seen) > 200_000:
                seen = set()
            for lo in range(0, b.num_rows, 500):
                n, sig, prefix, rare = [], [], [], []
                hi = min(lo + 500, b.num_rows)
                for _, s in doc_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    x = _signature(s)
                    n.append(len(s))
                    sig.append(x)
                    p, k = (None, None) if x in seen or not len(s) else _prefix(s, often, percent)
                    prefix.append(None if p is None else p.view(np.int64))
                    rare.append(k)
                    seen.add(x)
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int32()), pa.array(sig, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "row", "n", "sig", "prefix", "rare"])

    return docs.select("id", "row", "text").mapInArrow(trimmed(run), f"id {docs.schema['id'].dataType.simpleString()}, row long, n int, sig long, prefix array<long>, rare int")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, n, tokens) of the texts of `docs` (row, text) whose row is in `wanted`; a set may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, off = flat(b.column(0))
            for lo in range(0, b.num_rows, 200):
                hi = min(lo + 200, b.num_rows)
                out = {}
                for _, s in doc_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    x = _signature(s)
                    if x not in seen:
                        out[x] = s
                seen = (seen if len(seen) < 200_000 else set()) | out.keys()
                sets = list(out.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sig", "n", "tokens"])

    if fits_broadcast(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "row", "left_semi").select("text").mapInArrow(trimmed(run), "sig long, n int, tokens array<long>")


def flat_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values sorted as unsigned hashes, offsets) of a list<long> column."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.asarray(col.values).view(np.uint64), off


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, as a product of 0/1 matrices over slices of the tokens."""
    if len(x) == len(y) == 1:
        return np.array([[len(np.intersect1d(x[0], y[0], assume_unique=True))]])
    own = x is y
    sets = x if own else x + y
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times > 1
    keep = many[col]
    row, col = row[keep], (np.cumsum(many) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(many.sum()), 4096):
        i, j = np.searchsorted(col, (lo, lo + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[i:j], col[i:j] - lo] = 1
        out += part @ part.T if own else part[: len(x)] @ part[len(x) :].T
    return np.rint(out).astype(np.int64)


class Pair:
    """The members of two blocks: side 0 and side 1, or side 1 with itself if there is no side 0."""

    def __init__(self) -> None:
        self.side, self.sig, self.n, self.comp, self.tokens = [], [], [], [], []

    def add(self, side: int, sig: int, n: int, comp: int, tokens: np.ndarray) -> None:
        if not (self.sig and self.sig[-1] == sig and self.side[-1] == side):
            for held, x in zip((self.side, self.sig, self.n, self.comp, self.tokens), (side, sig, n, comp, tokens), strict=True):
                held.append(x)

    def compare(self) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Members i and j of either side, common tokens of i with j, and sizes as a column and a row; equal components have none in common."""
        j = [k for k, x in enumerate(self.side) if x]
        i = [k for k, x in enumerate(self.side) if not x] or j
        y = [self.tokens[k] for k in j]
        both = _common(y if i is j else [self.tokens[k] for k in i], y)
        n, comp = np.array(self.n), np.array(self.comp)
        return i, j, np.where(comp[i][:, None] == comp[j], -1, both), n[i][:, None], n[j]


def _links(x: Pair, percent: int) -> list[tuple]:
    """(a, b): links that connect all members that similar pairs connect."""
    i, j, both, n, m = x.compare()
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while (u := root.get(v, v)) != v:
            root[v] = v = root.get(u, u)
        return v

    out = []
    for a, b in zip(*np.nonzero((both > 0) & (100 * both >= percent * (n + m - both))), strict=True):
        if (u := top(i[a])) != (v := top(j[b])):
            root[u] = v
            out.append((x.sig[i[a]], x.sig[j[b]]))
    return out


def _possible(x: Pair, percent: int) -> list[tuple]:
    """(side, sig, n, comp) of the members that have a possible partner: similar sets of sizes n <= m have more than
    p (100 n - p m) / (100 (100 + p)) prefix tokens in common."""
    i, j, both, n, m = x.compare()
    least, large = np.minimum(n, m), np.maximum(n, m)
    may = (both > 0) & (100 * least >= percent * large) & (both * (100 * (100 + percent)) > percent * (100 * least - percent * large))
    keep = {i[k] for k in np.flatnonzero(may.any(1))} | {j[k] for k in np.flatnonzero(may.any(0))}
    return [(x.side[k], x.sig[k], x.n[k], x.comp[k]) for k in sorted(keep)]


def _by_pair(rows: DataFrame, body, percent: int, schema: str, keep_pair: bool) -> DataFrame:
    """body(members) for each block pair of `rows` (pair, side, sig, n, comp, tokens); a task reads one pair after another."""
    kinds = [pa.int64() if "long" in c else pa.int32() for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Pair()

        def found() -> list[tuple]:
            got = body(held, percent) if any(held.side) else []
            return [(now, *x) for x in got] if keep_pair else got

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in enumerate(kinds)], names)

        for x in batches:
            values, off = flat_lists(x.column(5))
            out = []
            for k, (pair, *member) in enumerate(zip(*(x.column(c).to_pylist() for c in range(5)), strict=True)):
                if pair != now:
                    out += found()
                    now, held = pair, Pair()
                held.add(*member, values[off[k] : off[k + 1]].copy())
            yield batch(out)
        yield batch(found())

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("pair", "side", "sig", "n", "comp", "tokens").repartition(parts, "pair").sortWithinPartitions("pair", "side", "sig")
    return dealt.mapInArrow(trimmed(run), schema)


def _verified(tests: DataFrame, docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within the block pairs of `tests` (pair, side, sig, n, comp), by whole sets.

    docs: (row, text); rows: (sig, row of a text that has the set)."""
    wanted = durable(rows.join(tests.select("sig").distinct(), "sig", "left_semi").select("row"))
    sets = whole_sets(docs, wanted).select("sig", "tokens")
    out = durable(_by_pair(tests.hint("merge").join(sets, "sig"), _links, percent, "a long, b long", False))
    drop_durable(wanted)
    return out


def _sizes_fit(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _parts(count, tokens):
    """Number of blocks for so many sets and tokens."""
    return F.greatest(F.ceil(count / MEMBERS), F.ceil(tokens / TOKENS), F.lit(1)).cast("int")


def _part(sig, parts):
    return F.pmod(F.xxhash64(sig, F.lit(7)), parts).cast("int")


def shared_tokens(found: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, most, able): the prefix tokens that several sets have, one row for each set that has it.

    most: size of the largest partner that the token's place in the set allows; able: whether some set fits by size.
    Tokens from the list of frequent ones are shared for certain; only the others are dealt out by token to find out."""
    have = found.where(F.col("prefix").isNotNull())
    n, i = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    most = F.floor((n - i) * (100 + percent) / percent) - n
    at = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).alias("at")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = have.select("sig", "n", F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("i", "token")).select("token", "sig", at)
    often = have.where(F.size("prefix") > F.col("rare")).select("sig", "n", "rare", F.posexplode(F.slice("prefix", F.col("rare") + 1, F.size("prefix"))).alias("k", "token"))
    often = often.withColumn("i", F.col("k") + F.col("rare")).select("token", "sig", at)
    ends = [F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.min(n).alias("least"), F.max(most).alias("reach")]
    dealt = rare.repartition(parts, "token")
    out = [x.join(x.groupBy("token").agg(*ends).where("lo <> hi"), "token") for x in (dealt, often)]
    able = (most * 100 >= n * percent) & (F.col("least") <= most) & (F.col("reach") >= n)
    rows = [x.select("token", "sig", n.cast("int").alias("n"), most.cast("int").alias("most"), able.alias("able")).distinct() for x in out]
    return rows[0].unionByName(rows[1])


def links(docs: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between distinct sets that together connect all sets that similar pairs connect.

    docs: (row, text); found: the durable table of documents()."""
    # 1. prefix tokens that more than one set has
    before = durable(shared_tokens(found, percent))
    shared = durable(before.join(before.where("able").select("sig").distinct(), "sig", "left_semi"))
    drop_durable(before)

    # 2. leaders, and who is similar to them
    named = shared.groupBy("token").agg(F.max_by("sig", F.xxhash64("sig")).alias("leader"))
    votes = shared.join(named, "token").groupBy("sig", "leader").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    group = durable(votes.groupBy("sig").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader"), F.first("n").alias("n")))
    rows = found.where(F.col("prefix").isNotNull()).groupBy("sig").agg(F.min("row").alias("row"))
    rows = durable(rows.join(group.select("sig"), "sig", "left_semi"))
    follow = group.where("sig <> leader").join(group.select(F.col("sig").alias("leader"), F.col("n").alias("m")), "leader").where(_sizes_fit("n", "m", percent)).select("sig", "n", "leader", "m")
    blocks = follow.groupBy("leader").agg(_parts(F.count("*"), F.sum("n")).alias("parts"), F.first("m").alias("m"))
    one = F.xxhash64("leader", "part").alias("pair")
    members = follow.join(blocks, "leader").withColumn("part", _part("sig", F.col("parts"))).select("sig", "n", one, F.lit(1).alias("side"))
    lead = blocks.select(F.col("leader").alias("sig"), F.col("m").alias("n"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("sig", "n", one, F.lit(0).alias("side"))
    tests = durable(members.unionByName(lead).withColumn("comp", F.col("sig")))
    first = _verified(tests, docs, rows, percent)
    drop_durable(tests)

    # 3. the matrix: components among those, loose groups of the others
    part = connected(first, "a", "b").select(F.col("node").alias("sig"), "component")
    mine = group.join(part, "sig", "left").select("sig", "n", F.coalesce("component", "sig").alias("comp"), F.when(F.col("component").isNull(), F.xxhash64("leader", F.lit(2))).otherwise(F.xxhash64("component", F.lit(1))).alias("grp"))
    placed = durable(mine)
    blocks = placed.groupBy("grp").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    placed, before = durable(placed.join(blocks, "grp").select("sig", "n", "comp", "grp", F.xxhash64("grp", _part("sig", F.col("parts"))).alias("block"))), placed
    drop_durable(before, group)
    held = shared.join(placed.select("sig", "comp", "grp"), "sig")
    several = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    held = durable(held.join(several, "token"))
    cells = held.groupBy("token", F.col("grp").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("large"), F.max("most").alias("reach"), F.max("able").alias("g_able"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    n = F.col("n")
    sized = (F.col("least") * percent <= n * 100) & (F.col("large") >= n)  # some member with the token is large enough, and some small enough
    fits = F.col("able") & F.col("g_able") & (F.col("least") <= F.col("most")) & (n <= F.col("reach"))
    other = (F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))
    asked = held.join(cells, "token").where(other & sized).groupBy("sig", "n", "g").agg(F.count("*").alias("k"), F.max(fits).alias("fits"), F.max("large").alias("large"), F.max(F.when(fits, F.col("most"))).alias("most"))
    # a set asks for partners at least as large as itself, and at most as large as the place of their first common token
    # allows: at least so many of the shared tokens lie in both prefixes
    largest = F.least(F.col("large"), F.col("most"), F.floor(n * 100 / percent))
    opened = asked.where(F.col("fits") & (F.col("k") * (100 * (100 + percent)) > percent * (100 * n - percent * largest)))
    opened = opened.select("sig", "n", "g").join(placed.select("sig", "block"), "sig").groupBy("block", "g").agg(F.min("n").alias("least"), F.max("n").alias("large"))

    # open: block against block
    inside = placed.groupBy(F.col("grp").alias("g"), F.col("block").alias("other")).agg(F.min("n").alias("m_least"), F.max("n").alias("m_large"))
    pairs = opened.join(inside, "g").where((F.col("least") <= F.col("m_large")) & (F.col("m_least") * percent <= F.col("large") * 100))
    pairs = durable(pairs.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).distinct())
    key = F.xxhash64("x", "y").alias("pair")
    sides = pairs.select(key, F.col("y").alias("block"), F.lit(1).alias("side")).unionByName(pairs.where("x <> y").select(key, F.col("x").alias("block"), F.lit(0).alias("side")))
    lists = placed.join(held.groupBy("sig").agg(F.collect_list("token").alias("tokens")), "sig").select("sig", "n", "comp", "block", "tokens")
    tests = durable(_by_pair(sides.join(lists, "block"), _possible, percent, "pair long, side int, sig long, n int, comp long", True))
    rest = _verified(tests, docs, rows, percent)
    out = durable(first.unionByName(rest))
    drop_durable(shared, first, placed, held, pairs, tests, rest, rows)
    return out


def labelled(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, row, n, sig, comp, least) of `docs` (id, row, text): comp tells components apart and is null for empty sets;
    least is the smallest id of the component."""
    small_batches(docs.sparkSession)
    often = frequent_tokens(docs)
    found = durable(documents(docs, often, percent))
    pairs = links(docs.select("row", "text"), found, percent)
    part = connected(pairs, "a", "b").withColumnRenamed("node", "sig")
    classes = found.where("n > 0").groupBy("sig").agg(F.min("id").alias("first"))
    label = durable(classes.join(part, "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("comp")))
    lead = label.groupBy("comp").agg(F.min("first").alias("least"))
    label, before = durable(label.select("sig", "comp").join(lead, "comp")), label
    out = durable(found.select("id", "row", "n", "sig").join(label, "sig", "left").select("id", "row", "n", "sig", "comp", "least"))
    drop_durable(found, before, pairs, label)
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(text, key).alias("row"), F.col(text).alias("text"))


def components(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) of each row.

    Empty and null texts link with nothing. Repeated rows give repeated rows; rows that share a key share nothing but
    that. A row with a null key gets the component_id of the rows it is linked with, null if none of them has a key."""
    rows = labelled(_keyed(docs, key, text), percent)
    return rows.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; all columns stay.

    Rows without words are linked with nothing and stay. Of repeated rows (same doc_id and text) one stays; a row without
    a doc_id stays only if no row of its group has one."""
    label = labelled(_keyed(docs, "doc_id", "text"))
    rows = label.where("n > 0").select("row", "id", "comp")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count("*").alias("members")).where("members > 1")
    judged = rows.join(best, "comp").groupBy("row").agg(F.max(F.col("row") == F.col("best.row")).alias("stays"), F.count("*").alias("times"))
    mark = fresh(docs, "row")
    judged = durable(judged.where("NOT stays OR times > 1").withColumnRenamed("row", mark))
    drop_durable(label)
    marked = docs.withColumn(mark, F.xxhash64("text", "doc_id"))
    gone = judged.select(mark)
    kept = marked.join(F.broadcast(gone) if fits_broadcast(gone, BROADCAST_ROWS) else gone, mark, "left_anti")
    if judged.where("stays").limit(1).count():
        kept = kept.unionByName(marked.join(judged.where("stays").select(mark), mark, "left_semi").dropDuplicates([mark]))
    return kept.select(*docs.columns)
