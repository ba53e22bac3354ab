"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns find emails, IP addresses, card and phone numbers. These seed entities induce lexical patterns: the
words on either side. A graph links patterns with the instances they surround: base finds, identifier-like tokens,
and whatever else stands in a context that several seeds share, with or without digits (see `candidates`). In each
round a pattern's confidence in a kind is the share of its instances that are of this kind, as far as known, and an
instance's score is what its patterns say together; patterns with enough distinct seeds and high confidence thus
discover identifiers that no base pattern describes, whose contexts then support further patterns. Tokens are found
wherever they stand, other runs of words only where their own context says so. Contexts reach 48 characters; quotes
around a value don't count as words, so `token = "x"` and `token = x` give one context.

Besides the base finds, long tokens of letters and digits (`_secret_like`) seed a fifth kind, `secret`: two thirds of
them, by a hash of the value. The rest are candidates like any other token. Their shape reports nothing: a seed becomes a
span where a pattern that several share vouches for it, and what is no seed, of whatever shape, where the patterns'
confidence says so. `evaluate` hides a third of the seeds of every kind and tells how many come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, fits_broadcast, fresh
from .native import let, running

#: The base patterns, written with possessive loops (same matches, no deep recursion). A local part starts
#: where no character of one stands before it, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans; and those whose spans come from the graph alone.
ALL_KINDS, HIDDEN = (*KINDS, "secret"), ("token", "secret")
#: Other identifier-like tokens: a run of token characters, and what a short word in brackets joins to it, with at least
#: five digits in all.
TOKEN = r"(?<![A-Za-z0-9_.+@/=-])(?=[A-Za-z_.+@/=-]*+[0-9])[A-Za-z0-9_.+@/=-]{6,}+(?:[(\[{][A-Za-z]{1,8}+[)\]}][A-Za-z0-9_.+@/=-]++)*+"

#: A token of the kind `secret` has this many characters, and letters and digits in it, at least.
SECRET_SIZE, SECRET_LETTERS = 32, 5
#: One in so many of these tokens is no seed, and one in so many seeds is hidden by evaluate().
HELD_OUT = 3
_QUOTES = "[\"'`]"
MIN_SEEDS, CONFIDENCE, ROUNDS, PRIOR = 3, 0.8, 3, 1.0
#: Least share of a pattern's contexts in the whole corpus that have a seed.
PRECISION = 0.2
#: Contexts are counted in one of so many rows first, then in more, at last in all.
PARTS = (32, 4, 1)
_NEAR = 48
#: Words in a candidate, and in one that is a run of groups of digits; marks that don't belong to a word at its ends.
MAX_WORDS, MAX_GROUPS = 4, 16
_OPENING, _CLOSING, _IN_NUMBERS = "([{<\"'", ")]}>\"'.,;:!?", "0123456789()+-./"
#: Most useful patterns, and patterns with a confidence, that are broadcast; beyond that the joins shuffle.
BROADCAST_PATTERNS = 1_000_000
SPANS = "array<struct<kind:string,s:int,e:int,v:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, s, e, v>> of the leftmost non-overlapping matches, s and e in code points.

    The pieces between matches give the positions."""

    def place(both: Column) -> Column:
        steps = running(F.transform(both, lambda x: x.g + F.char_length(x.v)))
        return F.zip_with(both, steps, lambda x, b: F.struct(F.lit(kind).alias("kind"), (b + x.g).alias("s"), (b + x.g + F.char_length(x.v)).alias("e"), x.v.alias("v")))

    def pair(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        both = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), F.char_length(g).alias("g")))
        return F.when(F.size(found) > 0, let(both, place)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    digit = lambda d, i: d.substr(i, F.lit(1)).cast("int")
    total = lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(d, i))).otherwise(digit(d, i)))
    return let(F.reverse(_digits(v)), total) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    v = x.v
    if kind == "ip":
        return ~F.exists(F.split(v, r"\."), lambda p: ~p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(v))
        return F.when((n >= 13) & (n <= 19), _luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _checked(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: _valid(kind, x))


def _secret_like(v: Column) -> Column:
    return (F.char_length(v) >= SECRET_SIZE) & (F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")) >= SECRET_LETTERS) & ~v.rlike(r"[.@()\[\]{}]")


def _held_out(v: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), v), F.lit(HELD_OUT)) == 0


def base_spans(df: DataFrame, text: str = "text", out: str = "base", hold: bool = True) -> DataFrame:
    """`df` with the base spans as array<struct<kind, s, e, v>>, by kind as listed, then start, and column `tokens`:
    other identifier-like tokens, of kind token or secret. Only texts that hold a character that a kind needs are searched for it."""
    t = F.col(text)
    df = df.withColumn(text, F.coalesce(t, F.lit(""))).withColumn("__digit", t.rlike("[0-9]"))
    digit = F.col("__digit")
    for name, pattern, needed in (("email", EMAIL, t.contains("@")), ("ip", IP, digit), ("card", CARD, digit), ("phone", PHONE, digit & t.contains("+")), ("token", TOKEN, digit)):
        df = df.withColumn(f"__{name}", F.when(needed, matches(t, pattern, name)).otherwise(F.array().cast(SPANS)))
    df = df.withColumn(out, F.concat(*[_checked(F.col(f"__{k}"), k) for k in KINDS]))
    clear = lambda x, base: (F.length(_digits(x.v)) >= 5) & ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e))
    named = lambda x: F.struct(F.when(_secret_like(x.v) & (~_held_out(x.v, "seed") if hold else F.lit(True)), "secret").otherwise("token").alias("kind"), x.s.alias("s"), x.e.alias("e"), x.v.alias("v"))
    df = df.withColumn("tokens", let(F.col(out), lambda base: F.transform(F.filter("__token", lambda x: clear(x, base)), named)))
    return df.drop("__digit", "__token", *[f"__{k}" for k in KINDS])


def _contexts(text: Column, spans: Column) -> Column:
    """Each span with the two words before and after it, lower-cased and without quotes; missing ones are empty."""
    bare = lambda x: F.regexp_replace(F.lower(x), _QUOTES, "")
    tail = lambda x: F.regexp_extract_all(bare(F.substring(text, F.greatest(x.s - _NEAR, F.lit(0)) + 1, F.least(x.s, F.lit(_NEAR)))), F.lit(r"[^\s]+"), F.lit(0))
    head = lambda x: F.regexp_extract_all(bare(F.substring(text, x.e + 1, F.lit(_NEAR))), F.lit(r"[^\s]+"), F.lit(0))
    word = lambda words, i: F.coalesce(F.get(words, i), F.lit(""))

    def one(x: Column) -> Column:
        a, b = tail(x), head(x)
        n = F.size(a)
        return F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"), x.v.alias("v"), word(a, n - 2).alias("l2"), word(a, n - 1).alias("l1"), word(b, F.lit(0)).alias("r1"), word(b, F.lit(1)).alias("r2"))

    return F.transform(spans, one)


def occurrences(df: DataFrame, keys: list[str], text: str = "text", hide: bool = False) -> DataFrame:
    """keys, base (spans) and near (base spans and tokens with their context words): one row per row of `df`.

    hide: a third of the seeds of every kind, by a hash of their value, are tokens like any other, and their kind is in `was`."""
    df = base_spans(df.select(*keys, text), text, hold=not hide)
    lean = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))
    near = _contexts(F.col(text), F.concat("base", "tokens"))
    if not hide:
        return df.select(*keys, lean.alias("base"), near.alias("near"))
    gone = lambda x: (x.kind != "token") & _held_out(x.v, "hide")
    masked = F.transform(near, lambda x: x.withField("kind", F.when(gone(x), "token").otherwise(x.kind)))
    was = F.transform(F.filter(near, gone), lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))
    return df.select(*keys, F.filter(lean, lambda b: ~F.exists(was, lambda x: (x.s == b.s) & (x.e == b.e))).alias("base"), masked.alias("near"), was.alias("was"))


def _sides() -> list[tuple[str, Column]]:
    """(side, hash) of the patterns of one span with context words l2, l1, r1, r2, null where the text begins or ends instead."""
    h = lambda *x: F.xxhash64(*x)
    left, right = F.col("l1") != "", F.col("r1") != ""
    return [("l", F.when(left, h(F.lit("L"), "l2", "l1"))), ("r", F.when(right, h(F.lit("R"), "r1", "r2"))), ("b", F.when(left | right, h(F.lit("B"), "l1", "r1"))), ("l", F.when(F.col("l1").rlike("[:=#]$"), h(F.lit("C"), "l1")))]


def _patterns(near: DataFrame, *cols: str) -> DataFrame:
    """cols, side and p: a row for each pattern of each span of `near`."""
    each = F.array(*[F.struct(F.lit(side).alias("side"), h.alias("p")) for side, h in _sides()])
    return near.select(*cols, F.explode(each).alias("x")).select(*cols, "x.*").where(F.col("p").isNotNull())


def _context_hashes(text: Column) -> Column:
    """Hashes of the patterns whose context stands at each word of a text: what a value next to it would have as `_sides`."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), _QUOTES, ""), r"\s+"), lambda x: x != "")
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))

    def each(w: Column) -> Column:
        one = lambda x, i: F.array(F.xxhash64(F.lit("L"), at(w, i - 1), x), F.xxhash64(F.lit("R"), x, at(w, i + 1)), F.xxhash64(F.lit("B"), x, at(w, i + 2)), F.when(F.substring(x, -1, 1).isin(":", "=", "#"), F.xxhash64(F.lit("C"), x)))
        return F.flatten(F.transform(w, one))

    return let(words, each)


def _precise(seeded: DataFrame, found: DataFrame, rows: DataFrame, text: str, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """(p), and (row) of the texts that hold their contexts: patterns around `min_seeds` different seeds or more whose contexts, wherever they stand in the corpus, have a
    seed in a PRECISION of all cases. Common word pairs that happen to stand beside some seeds fall out here, before
    what else stands in their contexts is looked at.

    Contexts next to brackets or stops, which aren't words of their own, count where they stand beside seeds only."""
    useful = durable(seeded.groupBy("p").agg(F.count("seed").alias("seeds")).where(F.col("seeds") >= min_seeds).select("p"))
    left = durable(found.groupBy("p").agg(F.count("*").alias("beside")).join(_small(useful), "p", "left_semi"))
    drop_durable(useful)
    for part in PARTS:
        # What a part of the rows holds is a lower bound: common contexts show there already, and only the others are counted in more.
        some = rows if part == 1 else rows.where(F.pmod("row", F.lit(part)) == 0)
        contexts = some.select("row", F.explode(_context_hashes(F.col(text))).alias("p")).where(F.col("p").isNotNull())
        held = durable(contexts.join(_small(left.select("p")), "p", "left_semi").groupBy("p", "row").agg(F.count("*").alias("n")))
        everywhere = held.groupBy("p").agg(F.sum("n").alias("everywhere"))
        before, left = left, durable(left.join(everywhere, "p", "left").where(F.col("beside") >= PRECISION * F.coalesce("everywhere", "beside")).select("p", "beside"))
        drop_durable(before, *([held] if part > 1 else []))
    out = durable(left.select("p"))
    holding = durable(held.join(_small(out), "p", "left_semi").select("row").distinct())
    drop_durable(left, held)
    return out, holding


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_PATTERNS) else df


def _bitmap(useful: DataFrame, power: int) -> DataFrame:
    """One row with 2**power longs in which the bits of the patterns' hashes are set."""
    at = F.shiftrightunsigned("p", 64 - power)
    word = useful.groupBy(at.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b"))
    every = useful.sparkSession.range(1 << power).join(word, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x.b).alias("bits"))


def _runs(pieces: Column, bits: Column, power: int) -> Column:
    """array<struct<kind, s, e, v, l2, l1, r1, r2>> of the runs of words in `pieces`, a text split at each white space, whose context has its bits set.

    A unit is a word, or a longest run of groups of digits: one side is enough. Other runs of up to MAX_WORDS words need both sides."""
    none, zero = F.lit(""), F.lit(0)
    may = lambda *x: let(F.xxhash64(*x), lambda h: F.getbit(F.get(bits, F.shiftrightunsigned(h, 64 - power).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1)

    bare = lambda x: F.regexp_replace(F.lower(x), _QUOTES, "")

    def split(x: Column) -> Column:
        left = F.ltrim(x.v, F.lit(_OPENING))
        core = F.rtrim(left, F.lit(_CLOSING))
        a = F.char_length(x.v) - F.char_length(left)
        b = a + F.char_length(core)
        number = core.rlike("^[0-9()+./-]*[0-9][0-9()+./-]*$") & F.substring(core, 1, 1).isin(*_IN_NUMBERS)
        return F.struct(x.i.alias("i"), bare(x.v).alias("v"), a.alias("a"), b.alias("b"), bare(F.substring(x.v, F.lit(1), a)).alias("lead"), bare(F.substring(x.v, b + 1, F.char_length(x.v))).alias("trail"), number.alias("number"))

    def flagged(words: Column) -> Column:
        v = lambda i: F.coalesce(F.get(words, i).v, none)

        def one(x: Column, i: Column) -> Column:
            l1, l2 = F.when(x.lead != "", x.lead).otherwise(v(i - 1)), F.when(x.lead != "", v(i - 1)).otherwise(v(i - 2))
            r1, r2 = F.when(x.trail != "", x.trail).otherwise(v(i + 1)), F.when(x.trail != "", v(i + 1)).otherwise(v(i + 2))
            marked = l1.endswith(":") | l1.endswith("=") | l1.endswith("#")
            return F.struct(i.alias("k"), x.i.alias("i"), x.a.alias("a"), x.b.alias("b"), x.number.alias("number"), may(F.lit("BL"), l1).alias("bl"), may(F.lit("BR"), r1).alias("br"), l2.alias("l2"), l1.alias("l1"), r1.alias("r1"), r2.alias("r2"), (may(F.lit("L"), l2, l1) | (marked & may(F.lit("C"), l1))).alias("l"), may(F.lit("R"), r1, r2).alias("r"))

        return F.transform(words, one)

    def chosen(words: Column) -> Column:
        def unit(x: Column, i: Column) -> Column:
            after = lambda g: let(F.array_position(g, F.lit(False)).cast("int"), lambda k: F.when(k > 0, k).otherwise(F.size(g) + 1))
            inner = F.coalesce(F.get(words, i - 1).number, F.lit(False))
            return F.when(~x.number, F.lit(1)).when(inner, zero).otherwise(let(F.transform(F.slice(words, i + 2, F.lit(MAX_GROUPS - 1)), lambda y: y.number), after))

        def starts(x: Column, i: Column) -> Column:
            def of_unit(k: Column) -> Column:
                sizes = F.sequence(F.lit(1), F.lit(MAX_WORDS))
                end = lambda m: F.get(words, i + m - 1)
                good = lambda m: end(m).isNotNull() & ((x.l & end(m).r) | ((m == k) & (x.l | end(m).r)) | (x.bl & end(m).br & may(F.lit("B"), x.l1, end(m).r1))) & ((m > 1) | (x.b > x.a))
                return F.transform(F.filter(F.when(k > MAX_WORDS, F.concat(sizes, F.array(k))).otherwise(sizes), good), lambda m: F.struct(x.alias("x"), end(m).alias("y"), (m == k).alias("whole")))

            return let(unit(x, i), of_unit)

        return F.flatten(F.transform(F.filter(words, lambda x: x.l | x.r | x.bl | x.number), lambda x: starts(x, x.k)))

    start = lambda k: F.when(k > 0, F.char_length(F.array_join(F.slice(pieces, F.lit(1), k), " ")) + 1).otherwise(zero)
    words = F.transform(F.filter(F.transform(pieces, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x.v != ""), split)

    def run(z: Column) -> Column:
        x, y = z.x, z.y
        own = F.array_join(F.slice(pieces, x.i + 1, y.i - x.i + 1), " ")
        return let(start(x.i), lambda at: F.struct(F.when(z.whole, "word").otherwise("words").alias("kind"), (at + x.a).alias("s"), (at + F.char_length(own) - F.char_length(F.get(pieces, y.i)) + y.b).alias("e"), own.substr(x.a + 1, F.char_length(own) - F.char_length(F.get(pieces, y.i)) + y.b - x.a).alias("v"), x.l2.alias("l2"), x.l1.alias("l1"), y.r1.alias("r1"), y.r2.alias("r2")))

    return F.transform(let(let(words, flagged), chosen), run)


def candidates(rows: DataFrame, found: DataFrame, useful: DataFrame, marks: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """The saved tables to drop after use, and before them keys, kind ('word' for units, else 'words'), s, e, v, l2, l1, r1, r2 of the runs of words of `rows` that may stand in a useful context.

    A bitmap of the useful patterns, and of `marks`, the two words of those that need both sides, tells in each row which contexts to look at, so only these become rows. Runs that
    overlap a base span or lie in a token of `found` are left out."""
    power = max(6, min(16, (useful.count() * 8).bit_length()))
    bitmap = durable(_bitmap(useful.unionByName(marks), power))
    df = rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text)).crossJoin(F.broadcast(bitmap))
    # Written before anything else uses it, as filters and generators would each compute it again.
    runs = durable(df.select(*keys, let(F.split(text, r"\s", -1), lambda p: _runs(p, F.col("bits"), power)).alias("runs")))
    near = runs.select(*keys, F.explode("runs").alias("x")).select(*keys, "x.*")
    taken = found.select(*keys, F.filter("near", lambda x: x.kind.isin(*HIDDEN)).alias("tokens"), "base").where((F.size("tokens") > 0) | (F.size("base") > 0)).dropDuplicates(keys)
    s, e = F.col("s"), F.col("e")
    held = F.exists("base", lambda b: (b.s < e) & (s < b.e)) | F.exists("tokens", lambda b: (b.s <= s) & (e <= b.e))
    return near.join(taken, keys, "left").where(~F.coalesce(held, F.lit(False))).drop("base", "tokens"), [bitmap, runs]


def discover(found: DataFrame, keys: list[str], rows: DataFrame, text: str = "text", min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(keys, kind, s, e) of identifiers that no base pattern describes, from the pattern-instance graph of `found` and `rows`.

    Edges are counted once per distinct instance, so one value repeated a million times supports a pattern once."""
    near = found.select(*keys, F.explode("near").alias("x")).select(*keys, "x.*").withColumn("instance", F.xxhash64("v"))
    seeded = _patterns(near.where(F.col("kind") != "token"), "instance", "kind").groupBy("instance", "p").agg(F.min("kind").alias("seed"))
    useful, holding = _precise(seeded, _patterns(near.where(F.col("kind") != "token"), "kind"), rows, text, min_seeds)
    # Only documents with such a context have more candidates.
    rows = rows.join(_small(holding), "row", "left_semi")
    both = near.where(F.col("kind") != "token").select("l1", "r1", F.xxhash64(F.lit("B"), "l1", "r1").alias("p")).join(_small(useful), "p")
    marks = both.select(F.explode(F.array(F.xxhash64(F.lit("BL"), "l1"), F.xxhash64(F.lit("BR"), "r1"))).alias("p")).distinct()
    words, runs = candidates(rows, found, useful, marks, keys, text)
    words, before = durable(_patterns(words.withColumn("instance", F.xxhash64("v")), *keys, "kind", "s", "e", "instance").join(_small(useful), "p")), runs
    drop_durable(*before)
    # Whether a run of several words is one instance depends on both sides, so it speaks for neither side alone.
    counted = words.where((F.col("kind") == "word") | (F.col("side") == "b")).select("instance", F.lit(None).cast("string").alias("seed"), "p")
    edges = _patterns(near, "instance", "kind").join(_small(useful), "p").select("instance", F.when(F.col("kind") != "token", F.col("kind")).alias("seed"), "p")
    edges = durable(edges.unionByName(counted).groupBy("instance", "p").agg(F.min("seed").alias("seed")))
    size = durable(edges.groupBy("p").agg(F.count("*").alias("n")))
    seeds = edges.where(F.col("seed").isNotNull()).select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = seeds
    union = lambda c: 1 - F.exp(F.sum(F.log1p(-F.least(c, F.lit(0.999)))))
    steps = []
    for _ in range(rounds):
        said = edges.join(scores, "instance").groupBy("p", "kind").agg(F.sum("score").alias("mass")).join(size, "p")
        said = durable(said.select("p", "kind", (F.col("mass") / (F.col("n") + F.lit(PRIOR))).alias("conf")).where(F.col("conf") >= confidence / 2))
        new = edges.where(F.col("seed").isNull()).join(_small(said), "p").groupBy("instance", "kind").agg(union(F.col("conf")).alias("score"))
        scores = durable(seeds.unionByName(new.where(F.col("score") >= confidence / 2)))
        steps += [said, scores]
    good = edges.join(scores, "instance").where(F.col("seed").isNull() & (F.col("score") >= confidence)).select("instance", "kind", "score")
    vouched = edges.where(F.col("seed") == "secret").join(_small(said.where((F.col("kind") == "secret") & (F.col("conf") >= confidence))), "p").select("instance", "kind", F.col("conf").alias("score"))
    good = good.unionByName(vouched).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))
    tokens = near.where(F.col("kind").isin(*HIDDEN)).join(good, "instance").select(*keys, F.col("found").alias("kind"), "s", "e")
    side = lambda x: F.coalesce(F.max(F.when(F.col("side") == x, F.col("conf"))), F.lit(0.0))
    here = words.distinct().withColumnRenamed("kind", "unit").join(_small(said), "p").groupBy(*keys, "unit", "s", "e", "kind").agg(union(F.col("conf")).alias("score"), side("l").alias("l"), side("r").alias("r"), side("b").alias("b"))
    sure = (F.col("score") >= confidence) & ((F.col("unit") == "word") | (F.col("b") >= confidence) | ((F.col("l") > 0) & (F.col("r") > 0)))
    here = here.where(sure).groupBy(*keys, "s", "e").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")).select(*keys, "kind", "s", "e")
    out = durable(tokens.unionByName(here).distinct())
    drop_durable(useful, holding, words, edges, size, *steps)
    return out


def _merged(spans: Column) -> Column:
    """Overlapping spans as one with the kind of the first of the longest."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), (-x.e).alias("back"), x.kind.alias("kind"))))
    empty = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    span = lambda kind, s, e: F.array(F.struct(kind.alias("kind"), s.alias("s"), e.alias("e")))

    def add(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        longer = F.when(-x.back - x.s > last.e - last.s, x.kind).otherwise(last.kind)
        return F.when((F.size(a) > 0) & (x.s < last.e), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), span(longer, last.s, F.greatest(last.e, -x.back)))).otherwise(F.concat(a, span(x.kind, x.s, -x.back)))

    return F.aggregate(order, empty, add)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in ALL_KINDS]), k)
    tagged = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x.kind).alias("r"), x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"))))
    return F.transform(tagged, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, base and spans (base ones and discovered ones) of each row, as array<struct<kind, s, e>>.

    `row` tells texts of one key apart. Null texts count as empty and have no spans; repeated rows give repeated rows."""
    rows = docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key)).alias("row"), F.col(text))
    found = durable(occurrences(rows, [key, "row"], text))
    more = discover(found, [key, "row"], rows, text)
    extra = more.groupBy("row").agg(_merged(F.collect_list(F.struct("kind", "s", "e"))).alias("extra"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    out = durable(found.select(key, "row", "base").join(extra, "row", "left").select(key, "row", "base", _ordered(F.concat("base", F.coalesce("extra", none))).alias("spans")))
    drop_durable(found, more)
    return out


def evaluate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, hidden, found, right): seeds that were hidden, discovered spans of the kind, and hidden seeds among them with their
    kind. right / hidden is the recall of discovery; found less right are unseeded tokens or errors."""
    rows = docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key)).alias("row"), F.col(text)).dropDuplicates(["row"])
    seen = durable(occurrences(rows, [key, "row"], text, hide=True))
    more = discover(seen.drop("was"), [key, "row"], rows, text)
    hidden = seen.select("row", F.explode("was").alias("x")).select("row", "x.*")
    both = more.withColumn("found", F.lit(1)).join(hidden.withColumn("hidden", F.lit(1)), ["row", "kind", "s", "e"], "full")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = durable(both.groupBy("kind").agg(one("hidden").alias("hidden"), one("found").alias("found"), F.sum(F.when(F.col("hidden").isNotNull() & F.col("found").isNotNull(), 1).otherwise(0)).alias("right")))
    drop_durable(seen, more)
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base finds), base_sha256, spans (all), n_found (discovered), n_spans (all)."""
    got = find(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"), F.size("spans").cast("long").alias("n_spans"))


def redact(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in brackets; overlapping spans are replaced as one."""

    def parts(kept: Column) -> Column:
        end = lambda i: F.coalesce(F.get(kept, i).e, F.lit(0))
        pieces = F.transform(kept, lambda x, i: F.concat(text.substr(end(i - 1) + 1, x.s - end(i - 1)), F.lit("["), x.kind, F.lit("]")))
        return F.concat(F.array_join(pieces, ""), text.substr(end(F.size(kept) - 1) + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(_merged(spans), parts)).otherwise(text)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets in their texts replaced by their kind; n_chars follows the text.

    Null texts stay null. Only rows with spans are joined by more than their key; repeated rows stay repeated."""
    row, found = fresh(docs, "row"), fresh(docs, "spans")
    spans = find(docs).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(found)).dropDuplicates([row])
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    out = docs.withColumn(row, own).join(spans, row, "left").withColumn("text", redact(F.col("text"), F.coalesce(found, none)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
