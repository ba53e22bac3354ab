"""Document fingerprints: 128-bit SimHash, and all fingerprints within a Hamming radius by permuted block tables.

Words vote with a weight that grows with their length (long words are rarer) on each bit of their hash: +weight
where the bit is set, -weight where it isn't. Four bits share a 64-bit sum, one 16-bit lane each; lanes can't
overflow (2048 words of weight 15 stay below 2**15) because sums are kept per stretch of words first and unpacked when stretches are added up.

For the search, fingerprints are cut into blocks. Two fingerprints within radius r agree on at least blocks - r
blocks, so one table per choice of blocks - r blocks, keyed by their bits, holds every such pair. Equal fingerprints
count as one. Only DataFrame functions are used.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_durable, durable

BITS, BLOCKS, RADIUS = 128, 8, 6
_STRETCH, _MAX_WEIGHT = 2048, 15
_LANES = 0x0001000100010001
_SALTS = 1000


def _weight(word: Column) -> Column:
    return F.least(F.greatest(F.length(word) * 2 - 5, F.lit(1)), F.lit(_MAX_WEIGHT)).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """keys and `carry` with fp: 32 hex digits.

    `keys` tell the rows apart; rows that share all keys vote together. `carry` are number columns that depend on the
    keys. A constant term of weight 1 votes in every text, so that null, empty and blank texts get one fingerprint too."""
    carry = carry or []
    terms = F.split(F.concat(F.lit("\x01 "), F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")
    # Lanes are summed per row and stretch, so that repeated rows can't make them overflow.
    rows = texts.select(*keys, *carry, F.monotonically_increasing_id().alias("__row"), terms.alias("__terms"))
    rows = rows.select(*keys, *carry, "__row", F.posexplode("__terms").alias("__at", "__w")).where(F.col("__w") != "")
    halves = [F.xxhash64(F.col("__w"), F.lit(s)) for s in range(BITS // 64)]
    rows = rows.select(*keys, *carry, "__row", F.floor(F.col("__at") / _STRETCH).cast("int").alias("__part"), _weight(F.col("__w")).alias("__v"), *[h.alias(f"__h{n}") for n, h in enumerate(halves)])
    lane = lambda n, i: F.shiftrightunsigned(F.col(f"__h{n}"), i).bitwiseAND(F.lit(_LANES))
    packed = rows.groupBy(*keys, "__row", "__part").agg(
        *[F.max(c).alias(c) for c in carry], F.sum("__v").alias("__total"), *[F.sum(lane(n, i) * F.col("__v")).alias(f"__s{n}_{i}") for n in range(BITS // 64) for i in range(16)]
    )
    bit = lambda n, b: F.shiftrightunsigned(F.col(f"__s{n}_{b % 16}"), b // 16 * 16).bitwiseAND(F.lit(0xFFFF))
    sums = packed.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], F.sum("__total").alias("__total"), *[F.sum(bit(n, b)).alias(f"__b{n}_{b}") for n in range(BITS // 64) for b in range(64)])
    words = []
    for n in range(BITS // 64):
        for q in range(4):
            one = F.lit(0)
            for b in range(16):
                one = one + F.when(F.col(f"__b{n}_{q * 16 + b}") * 2 > F.col("__total"), F.lit(1 << b)).otherwise(F.lit(0))
            words.append(F.lpad(F.lower(F.hex(one)), 4, "0"))
    return sums.select(*keys, *carry, F.concat(*words).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints (hex strings) differ."""
    part = lambda x, k: F.conv(F.substring(x, 8 * k + 1, 8), 16, 10).cast("long")
    out = F.lit(0)
    for k in range(BITS // 32):
        out = out + F.bit_count(part(a, k).bitwiseXOR(part(b, k)))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Cosine similarity that the differing bits stand for, from 0 (unrelated) to 1 (equal)."""
    return F.round(F.greatest(F.cos(F.lit(3.141592653589793) * distance(a, b) / BITS), F.lit(0.0)), 6)


def within(queries: DataFrame, all_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, other, distance) for each fingerprint of `queries` and each different one of `all_fps` within `radius`.

    Both tables have a column fp; equal ones count once."""
    width = BITS // 4 // blocks
    tables = list(itertools.combinations(range(blocks), blocks - radius))
    if not tables or blocks <= radius:
        raise ValueError("the radius must be smaller than the number of blocks")
    cut = lambda t: F.concat(F.lit(f"{tables.index(t)}:"), *[F.substring("fp", width * b + 1, width) for b in t])
    half = lambda k: F.conv(F.substring("fp", 16 * k + 1, 16), 16, -10).cast("long")
    spread = lambda df, n: df.select("fp").distinct().select(half(0).alias(f"{n}0"), half(1).alias(f"{n}1"), F.explode(F.array(*[F.xxhash64(cut(t)) for t in tables])).alias("k"))
    bits = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = spread(queries, "a").hint("merge").join(spread(all_fps, "b"), "k").where(bits.between(1, radius)).select("a0", "a1", "b0", "b1", bits.alias("distance")).distinct()
    text = lambda n: F.lower(F.concat(*[F.lpad(F.hex(f"{n}{k}"), 16, "0") for k in range(2)]))
    return pairs.select(text("a").alias("fp"), text("b").alias("other"), "distance")


def following(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, next_id): each distinct id with the next larger one, the last with the first. Nulls are left out.

    Ids are dealt by range; within a range the order is local, and one row per range tells where the next begins. The dealt
    ids are saved, as bounds are drawn anew whenever they are computed and both uses must see the same ones."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(ids.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(parts, key).select(key, F.spark_partition_id().alias("p")))
    local = rows.withColumn("n", F.lead(key).over(Window.partitionBy("p").orderBy(key)))
    firsts = rows.groupBy("p").agg(F.min(key).alias("f"))
    order = Window.orderBy("p")
    firsts = firsts.select("p", F.coalesce(F.lead("f").over(order), F.min("f").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("g"))
    return local.join(firsts, "p").select(key, F.coalesce("n", "g").alias("next_id"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """at, text, edited: the last floor(n/4) characters replaced by the first as many (or all) of the next document.

    `at` holds the id and a salt, and the result is partitioned by it. Rows without id have no next document; they are
    spread by a hash of their text, and repeated ones count once."""
    own = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    quarter = lambda x: F.floor(F.char_length(x) / 4).cast("int")
    at = lambda col, salt: F.struct(F.col(col).alias("id"), F.coalesce(salt.cast("int"), F.lit(0)).alias("salt")).alias("at")
    most = docs.groupBy(key).agg(F.max(quarter(F.coalesce(F.col(text), F.lit("")))).alias("q"))
    want = following(docs, key).join(most, key).select(F.col(key).alias("for_id"), at("next_id", F.lit(0)), "q")
    nameless = own.where(F.col(key).isNull()).distinct().select(at(key, F.pmod(F.xxhash64("text"), F.lit(_SALTS)) + 1), "text")
    # Both joins read the texts in one form, so that they are shuffled once, and all grouping by `at` keeps that shuffle.
    rows = own.where(F.col(key).isNotNull()).select(at(key, F.lit(0)), "text").unionByName(nameless).repartition("at")
    heads = rows.join(want, "at").select(at("for_id", F.lit(0)), F.expr("substring(text, 1, q)").alias("head")).groupBy("at").agg(F.min("head").alias("head"))
    out = rows.join(heads, "at", "left").withColumn("q", quarter(F.col("text"))).withColumn("n", F.char_length("text"))
    return out.select("at", "text", F.expr("concat(substring(text, 1, n - q), substring(coalesce(head, ''), 1, q))").alias("edited"))


def compare(docs: DataFrame, radius: int = RADIUS, query_every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    n_within: for documents whose doc_id is divisible by `query_every`, how many other documents have a fingerprint
    within `radius`; null for the others. Null texts count as empty. A row without doc_id has no next document: its
    edited text ends early and near_next is 1. Repeated rows give repeated rows; of several texts with one doc_id the
    next document is the one whose head, or for near_next whose fingerprint, is smallest."""
    both = edited(docs.select("doc_id", "text"))
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id"))
    times = docs.groupBy(own.alias("row")).agg(F.count("*").alias("times")).where("times > 1")
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    tall = both.select("at", F.xxhash64("text", "at.id").alias("row"), F.char_length("text").cast("long").alias("n_chars"), *quarters, F.explode(F.array(F.struct(F.lit(0).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(1).alias("is_edited"), F.col("edited").alias("t")))).alias("x"))
    tall = tall.select("at", "row", "n_chars", "d0", "d1", "d2", "d3", "x.is_edited", "x.t")
    fp = fingerprints(tall, ["at", "row", "is_edited"], "t", ["n_chars", "d0", "d1", "d2", "d3"])
    pick = lambda k, name: F.max(F.when(F.col("is_edited") == k, F.col("fp"))).alias(name)
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"d{k}"), 16, "0") for k in range(4)]))
    one = fp.groupBy("at", "row", "n_chars", "d0", "d1", "d2", "d3").agg(pick(0, "fingerprint"), pick(1, "edited_fingerprint"))
    one = one.join(times, "row", "left").withColumn("each", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times").cast("int"), F.lit(1)))))
    one = durable(one.select(F.col("at.id").alias("doc_id"), "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint"))
    after = following(one).join(one.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next_fp")), "next_id").select("doc_id", "next_fp")
    copies = one.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"))
    asked = one.where(F.col("doc_id") % query_every == 0).select(F.col("fingerprint").alias("fp"))
    near = within(asked, copies, radius).join(copies.select(F.col("fp").alias("other"), F.col("n").alias("m")), "other").groupBy("fp").agg(F.sum("m").alias("m"))
    around = copies.join(near, "fp", "left").select(F.col("fp").alias("fingerprint"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("around"))
    out = one.join(after, "doc_id", "left").join(around, "fingerprint", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fp", "fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % query_every == 0, F.col("around")).alias("n_within"),
    )
