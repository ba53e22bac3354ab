"""Each operator against a brute-force version on awkward rows: nulls, blanks, repeats, ties, a long text, extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, decontam, huffman, langid, pages, pii, quality, simhash, suffix, tokengroup

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = [prose(150, k) for k in range(12)]


def near(text, k, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


TEXTS = [
    None, "", "   \n\t ", "one", "two words", *BASE[:6], BASE[0], BASE[0].upper(), near(BASE[1], 2, 1), near(BASE[1], 5, 2), near(BASE[1], 1, 3), BASE[2] + " " + BASE[7],
    BASE[8] + " " + BASE[9] + " " + BASE[0], "x" * 5000, prose(20000, 99), "é ü – “q” 日本 😀 " * 40, "a<|endoftext|> b <|endoftext|><|endoftext|",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, "n", 1, -1) for k, t in enumerate(TEXTS)]
    # columns named like the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, sig string, n int, row int").select("doc_id", "text", "sig", "n", "row")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def by_id():
    return {k * 3: t or "" for k, t in enumerate(TEXTS)}


RANKS = P.path("byte_bpe_50k.tiktoken")


def test_bpe(docs, none):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.round_trip(docs, RANKS, P.PATTERN, piece=64))
    assert len(got) == len(TEXTS)
    for k, t in by_id().items():
        ids = enc.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    back = bpe.decode_column(bpe.encode_column(docs.select("doc_id", "text"), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)


def test_token_files(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, at = rows(huffman.round_trip(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "f"))), 0
    for k, x in sorted(by_id().items()):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.round_trip(none, P.path("byte_bpe_50k.json"), str(tmp_path / "e")).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 16), (2, 16), (50, 6), (300, 9), (1000, 16)):
        c = np.concatenate([rng.integers(1, 10**6, n), [0]])
        lengths = huffman.code_lengths(c, limit)
        used = lengths[:n]
        assert used.max() <= limit and used.min() >= 1 and lengths[n] == 0 and (0.5**used).sum() <= 1
        ids = rng.integers(0, n, 5000).astype(np.uint32)
        bits, at = huffman.pack(ids, lengths, huffman.canonical(lengths)[1])
        assert (huffman.unpack(bits, at, len(ids), huffman.decode_table(lengths)) == ids).all()


def test_suffix_dedup(docs, none):
    size = 60
    bodies = [x.encode() for x in by_id().values()]
    seen = Counter(hash(b[i : i + size]) for b in bodies for i in range(len(b) - size + 1))
    got = rows(suffix.dedup(docs, length=size, window=30, keep_text=True))
    for k, t in by_id().items():
        b = t.encode()
        dead = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                dead[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~dead])
        spans = int((dead[1:] & ~dead[:-1]).sum() + (dead[0] if len(dead) else 0))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(b), int(dead.sum()), spans, kept)
    assert suffix.dedup(none).count() == 0


def word_sets():
    out = {}
    for k, t in by_id().items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_jaccard_components(docs, none):
    sets = word_sets()
    parent = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    got = rows(tokengroup.components(docs))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), parent[k]) for k, s in sets.items()}
    assert tokengroup.components(none).count() == 0


def test_jaccard_hot_group(spark):
    texts = [near(BASE[3], k % 12, k) for k in range(120)] + [BASE[3]] * 40 + [prose(100, 500 + k) + " " + BASE[4][:300] for k in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for k, t in enumerate(texts):
        w = t.split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if parent[a] != parent[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if v == y else v for v in parent]
    assert {k: r.component_id for k, r in rows(tokengroup.components(d)).items()} == dict(enumerate(parent))


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, BASE[0][:200]), (2, prose(30, 777)), (3, None), (4, BASE[2][100:400] + " extra"), (4, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontam.contained(docs, items).collect()}
    norm = lambda t: [w for w in re.findall(r"[^\W_]+", t.lower()) if w]
    sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    want = {}
    for i, t in ((1, BASE[0][:200]), (2, prose(30, 777)), (4, BASE[2][100:400] + " extra")):
        s = sh(norm(t))
        for k, x in by_id().items():
            n = len(s & sh(norm(x)))
            if n * 5 >= len(s) * 4:
                want[k, i] = n
    assert got == want and len(want) >= 4
    assert decontam.contained(none, items).count() == 0 and decontam.contained(docs, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_simhash(docs, none):
    got = rows(simhash.compare(docs))
    ids = sorted(by_id())
    for n, k in enumerate(ids):
        t, nxt = by_id()[k], by_id()[ids[(n + 1) % len(ids)]]
        q = len(t) // 4
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest() and got[k].n_chars == len(t)
    same = [k for k in ids if by_id()[k] == BASE[0]]
    assert len({got[k].fingerprint for k in same}) == 1 and simhash.compare(none).count() == 0
    long = [k for k in ids if len(by_id()[k].split()) > 100]
    assert sum(got[k].near_edited > got[k].near_next for k in long) >= len(long) - 4


def test_hamming_search(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(128) for _ in range(40)}
    for f in list(fps)[:15]:
        for n in (1, 3, 6, 7):
            x = f
            for b in rng.sample(range(128), n):
                x ^= 1 << b
            fps.add(x)
    h = [f"{x:032x}" for x in fps]
    d = spark.createDataFrame([(x,) for x in h], "fp string")
    got = {(r.fp, r.other) for r in simhash.within(d, d).collect()}
    assert got == {(a, b) for a in h for b in h if a != b and (int(a, 16) ^ int(b, 16)).bit_count() <= 6}


PII = ["write a.b@x-y.co.uk now", "a@b.c%d@e.f", "at 10.0.0.255 or 10.0.0.256 or 1.2.3.4.5", "card 4539 1488 0343 6467 and 4539148803436468", "+1 (212) 555-0100, +12", "5", "no data", None, "é 10.1.1.1 é@x.y z@x.y", "1 " * 3000, "@" * 500]


def pii_spans(x):
    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return sum(v if k % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for k, v in enumerate(d)) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base(spark, none):
    d = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = rows(pii.report(d))
    for k, t in enumerate(PII):
        want = pii_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[k].spans == want
    assert pii.report(none).count() == 0


def test_pii_discovers_and_redacts(spark):
    seen = [f"{prose(8, k)} my email is user{k}@mail{k}.example.org thanks {prose(5, 900 + k)}" for k in range(12)]
    unseen = f"{prose(8, 50)} my email is user12345(at)mail.example thanks {prose(4, 51)}"
    d = spark.createDataFrame(list(enumerate([*seen, unseen, prose(30, 3)])), "doc_id long, text string")
    got = rows(pii.report(d))
    assert got[12].n_found == 1 and got[12].spans.startswith("email:") and got[13].spans == "" and all(got[k].n_found == 0 for k in range(12))
    out = rows(pii.stage(spark, d.withColumn("n_chars", F.length("text").cast("long")), ""))
    assert "[email]" in out[0].text and "@" not in out[0].text and out[0].n_chars == len(out[0].text) and out[13].text == prose(30, 3)


def card(k):
    s = f"4539{k:011d}"
    d = [int(c) * 2 if n % 2 == 0 else int(c) for n, c in enumerate(reversed(s))]
    return s + str(-sum(v - 9 if v > 9 else v for v in d) % 10)


def test_pii_discovers_without_digits_and_in_groups(spark):
    seen = [f"{prose(8, k)} my email is user{k}@mail{k}.example.org thanks {prose(5, 900 + k)}" for k in range(12)] + [f"{prose(4, k)}  card number {card(k * 77)}, expires soon {prose(5, 700 + k)}" for k in range(12)]
    planted = {30: ("email", "jane.doe(at)mail.example", "my email is {} thanks"), 31: ("card", "4539 1488 0343 6468", "card number\n{}, expires soon"), 32: ("email", "jane at mail example", "my email is {} thanks"), 33: ("email", "user12345(at)mail.example", "my email is {} thanks"), 34: ("card", "4539 1488 0343 6468", "card number {} " + prose(3, 4))}
    texts = {k: f"{prose(7, 60 + k)} é😀 {c.format(v)} {prose(4, 80 + k)}" for k, (_, v, c) in planted.items()}
    d = spark.createDataFrame([*enumerate(seen), *texts.items(), (50, prose(300, 3)), (51, None), (52, "email is"), (53, " ")], "doc_id long, text string")
    got = rows(pii.report(d))
    assert {k: got[k].spans for k in planted} == {k: f"{kind}:{texts[k].index(v)}:{texts[k].index(v) + len(v)}" for k, (kind, v, _) in planted.items()}
    assert all(got[k].n_found == 0 for k in [*range(24), 50, 51, 52, 53])
    out = rows(pii.stage(spark, d, ""))
    assert out[30].text == texts[30].replace(planted[30][1], "[email]") and out[31].text == texts[31].replace(planted[31][1], "[card]")


def test_language(spark, none):
    langs = {"aa": "the and of with house water", "bb": "der und das haus wasser nicht", "cc": "el la casa agua que no los"}
    data = [(k, " ".join(random.Random(k).choices(langs[c].split(), k=25)), c, "x") for k, c in enumerate("aa bb cc".split() * 60)]
    data += [(1000, None, "aa", "x"), (1001, "", None, "x"), (1002, "123 ...", "bb", "x"), (1003, "Wasser und Haus nicht", None, "x"), (1003, "Wasser und Haus nicht", None, "x")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    rows_ = langid.identify(d).collect()
    got = {r.doc_id: r for r in rows_}
    assert len(rows_) == len(data) and all(got[k].lang_pred == c for k, _, c, _ in data[:180])
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert langid.identify(none).count() == 0
    assert langid.stage(spark, d, "").count() == len(data) - 3
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min((code[a] != code[b]).sum() for a in range(4) for b in range(a)) == 4


def test_quality(spark, none):
    good = [prose(40, k) for k in range(80)]
    bad = [" ".join(w + "***" for w in prose(40, 1000 + k).split()) for k in range(80)]
    d = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate([*good, *bad])] + [(900, None, 0.1), (901, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = rows(quality.assess(d, labels))
    assert all(got[k].predicted == int(k < 80) for k in range(160)) and 0 <= got[900].score == got[901].score <= 1
    assert {k for k in range(160) if got[k].held_out} == {k for k in range(160) if zlib.crc32(str(k).encode()) % 3 == 1}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.assess(none, empty).count() == 0 and quality.assess(d, empty).where("predicted = 1").count() == 162


def test_pages(spark):
    page = '<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href="#">Home</a></nav><div class="post-{n}"><h1>Head &amp; more</h1><p>First  <b>bold</b>\n text<p>Second&nbsp;text, long enough to count for something here.<div class="comments"><p>I like it</p></div></div><div class="sidebar">side words that go on</div><footer>&copy; foot</footer>'
    data = [(k, f"http://Host.example/{k}", page.replace("{n}", str(k))) for k in range(5)] + [(10, "http://host.example/x", None), (11, None, ""), (12, "odd", "<p>only</p>"), (13, "http://other/", "plain text")]
    d = spark.createDataFrame(data, "page_id long, url string, html string")
    got = rows(pages.extract(d), "page_id")
    assert got[0].text == "Head & more\nFirst bold text\nSecond text, long enough to count for something here." and got[0].n_chars == len(got[0].text)
    assert got[0].path == "html/body/div.post-#" and [got[k].text for k in (10, 11, 12, 13)] == ["", "", "only", "plain text"]
    assert pages.extract(d.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ['<div class="layout no-sidebar">', '<div id="content" class="post comments-open">', '<div class="widget">', "<form>"])
def test_pages_keep_wrapped_articles(wrap):
    page = f'<body>{wrap}<h1 class="header-title">Headline</h1><p>A long article that holds most of the text of this page. <span class="share">Share me</span></p><div class="sidebar">side words</div></div></body>'
    assert pages.text_of(page, None) == "Headline\nA long article that holds most of the text of this page."


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    texts = [*BASE[:4], near(BASE[0], 1, 5), "123 456", None, prose(60, 70) + " reach me at me@example.org " + prose(20, 71), prose(50, 80) + " " + BASE[11][:200]]
    spark.createDataFrame([(k, t, "aa" if k % 2 else "bb", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, BASE[11][:180])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = rows(corpus_pipeline.run(spark, d))
    assert sorted(got) == [0, 1, 2, 3, 7] and all(r.whole for r in got.values()) and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
    enc = bpe.load(RANKS, P.PATTERN)
    assert enc.decode(got[0].ids) == BASE[0] and "[email]" in enc.decode(got[7].ids)
