"""Rules that the operators state for odd rows, and parts of them against plain Python."""

import hashlib
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import BASE, by_id, docs, near, none, prose, rows  # noqa: F401

from brindle.llm import bpe, common, decontam, huffman, langid, pages, pii, simhash, suffix, tokengroup

import public_tokenizers as P


def components_of(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if parent[a] != parent[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if v == y else v for v in parent]
    return dict(enumerate(parent))


def test_jaccard_chains_sizes_and_shared_passages(spark, monkeypatch):
    """Chains whose ends aren't similar, sets contained in larger ones, boilerplate that many share, in small blocks."""
    monkeypatch.setattr(tokengroup, "MEMBERS", 6)
    monkeypatch.setattr(tokengroup, "OFTEN", 5)
    rng, texts = random.Random(4), []
    for k in range(6):  # chains: each text differs from the last one in a few words
        t = prose(rng.choice((40, 90, 200)), 300 + k)
        for j in range(9):
            texts.append(t)
            t = near(t, 1 + j % 2, 1000 * k + j)
    for k in range(10):  # prefixes and extensions around the threshold
        t = prose(100, 400 + k).split()
        texts += [" ".join(t), " ".join(t[:84]), " ".join(t[: 83 + k % 3]), " ".join([*prose(19 + k % 4, 500 + k).split(), *t])]
    common_part = prose(60, 600)
    texts += [f"{prose(n, 700 + n)} {common_part}" for n in range(4, 40)] + [common_part]
    got = rows(tokengroup.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: r.component_id for k, r in got.items()} == components_of(texts)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    texts = [(5, BASE[0]), (5, BASE[0]), (7, near(BASE[0], 1, 3)), (None, BASE[0]), (8, BASE[1]), (None, BASE[2]), (None, BASE[2]), (9, None), (9, None), (10, " ")]
    d = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, row int, sig int")
    got = tokengroup.stage(spark, d, "")
    assert got.columns == d.columns and sorted((r.doc_id or -1, (r.text or "")[:9]) for r in got.collect()) == sorted([(5, BASE[0][:9]), (8, BASE[1][:9]), (-1, BASE[2][:9]), (9, ""), (9, ""), (10, " ")])
    assert tokengroup.stage(spark, d.limit(0), "").count() == 0


@pytest.mark.parametrize("words", [5, 8, 12, 30, 70, 200])
def test_containment_search_misses_nothing(spark, words):
    """Documents that hold the least share of an item, and ones that just don't, at several item sizes."""
    item = prose(words, 900 + words).split()
    cuts = [" ".join([*prose(50, k).split(), *item[: len(item) - k], *prose(300, 40 + k).split()]) for k in range(max(1, words // 3))]
    d = spark.createDataFrame(list(enumerate(cuts)), "doc_id long, text string")
    got = {r.doc_id for r in decontam.contained(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    n = words - 4
    assert got == {k for k in range(len(cuts)) if (n - k) * 5 >= n * 4}


def test_decontamination_stage_judges_rows_by_their_text(spark, tmp_path):
    spark.createDataFrame([(1, BASE[3][:200]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(None, BASE[3]), (4, BASE[4]), (4, BASE[3]), (None, BASE[5]), (5, None), (4, BASE[4])]
    d = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, row int")
    got = decontam.stage(spark, d, str(tmp_path))
    assert got.columns == d.columns and sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(4, BASE[4]), (4, BASE[4]), (-1, BASE[5]), (5, "")])


def python_fingerprint(text):
    sums, total = [0] * 128, 0
    for word in ["\x01", *[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]]:
        weight = min(max(2 * len(word) - 5, 1), 15)
        total += weight
        first = xxhash.xxh64(word.encode(), seed=42).intdigest()
        for half in range(2):
            h = xxhash.xxh64(struct.pack("<i", half), seed=first).intdigest()
            for b in range(64):
                sums[half * 64 + b] += weight * (h >> b & 1)
    words = [sum(1 << b for b in range(16) if 2 * sums[half * 64 + q * 16 + b] > total) for half in range(2) for q in range(4)]
    return "".join(f"{x:04x}" for x in words)


def likeness(a, b):
    return round(max(np.cos(np.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128), 0), 6)


def test_fingerprints_equal_plain_simhash(docs, none):  # noqa: F811
    got, texts = rows(simhash.compare(docs)), by_id()
    ids = sorted(texts)
    fps = {k: python_fingerprint(texts[k]) for k in ids}
    for n, k in enumerate(ids):
        t, nxt = texts[k], texts[ids[(n + 1) % len(ids)]]
        q = len(t) // 4
        edited = python_fingerprint(t[: len(t) - q] + nxt[:q])
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (fps[k], edited)
        assert abs(got[k].near_edited - likeness(fps[k], edited)) < 2e-6 and abs(got[k].near_next - likeness(fps[k], fps[ids[(n + 1) % len(ids)]])) < 2e-6
        within = sum((int(fps[k], 16) ^ int(x, 16)).bit_count() <= 6 for i, x in fps.items() if i != k)
        assert got[k].n_within == (within if k % 20 == 0 else None)


def test_fingerprints_keep_every_row(spark):
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x y z w"), (None, None), (2, None), (2, "")], "doc_id long, text string")
    got = simhash.compare(d).collect()
    assert len(got) == 6 and sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2 and all(0 <= r.near_next <= 1 for r in got)


def brute_repeats(texts, size):
    seen = {}
    for t in texts:
        b = t.encode()
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for t in texts:
        b = t.encode()
        dead = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                dead[i : i + size] = True
        out.append((len(b), int(dead.sum()), int((dead[1:] & ~dead[:-1]).sum() + (dead[0] if len(dead) else 0))))
    return out


def test_repeats_at_full_length_over_many_batches(spark):
    """Passages of 380 to 460 bytes and more, overlapping ones, repeats inside a document, over many small Arrow batches."""
    rng, texts = random.Random(8), []
    passages = [prose(200, 800 + k) for k in range(6)]
    for k in range(120):
        p, n = passages[k % 6], rng.choice((379, 398, 399, 400, 401, 402, 420, 900))
        at = rng.randrange(40)
        texts.append(f"{prose(rng.randrange(90), 2000 + k)} {p[at : at + n]}{prose(rng.randrange(60), 3000 + k)}")
    texts += [texts[3], passages[0][:450] * 2, "é" * 500, "é" * 201, "ab" * 400]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(suffix.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in range(len(texts))] == brute_repeats(texts, 400)


def test_family_takes_batches_from_several_runs(spark, tmp_path):
    texts = [prose(200, 5000 + k % 9) + prose(30, k) for k in range(40)]
    found = suffix.suffixes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row long, text string"))
    met = set()
    for k in range(8):
        family = suffix.Family(spark, str(tmp_path / "family"))  # opened again for each batch
        met |= {r.key for r in family.add(suffix.array_of(found.where(F.col("row") % 8 == k))).collect()}
        assert [r for r, _ in family.levels] == [b for b in range(4, -1, -1) if (k + 1) >> b & 1]
    assert met == {r.key for r in found.groupBy("key").count().where("count > 1").collect()} and met


def secret(k):
    return "".join(random.Random(k).choices("0123456789abcdef", k=40))


def test_pii_finds_secrets_by_their_context(spark):
    seen = [f'{prose(8, k)} api_key = "{secret(k)}" {prose(5, 900 + k)}' for k in range(12)]
    odd = {20: "zk4-99817-qq", 21: secret(99)}
    texts = {k: f'{prose(7, 60 + k)} api_key = "{v}" {prose(4, 80 + k)}' for k, v in odd.items()}
    texts |= {30: f"{prose(5, 1)} checksum {secret(50)} {prose(5, 2)}", 31: prose(60, 7), 32: None}
    d = spark.createDataFrame([*enumerate(seen), *texts.items()], "doc_id long, text string")
    got = rows(pii.report(d))
    spans = lambda k, v: f"secret:{texts[k].index(v)}:{texts[k].index(v) + len(v)}"
    assert all(got[k].n_found == 1 and got[k].spans.startswith("secret:") for k in range(12))
    assert {k: got[k].spans for k in odd} == {k: spans(k, v) for k, v in odd.items()}
    assert got[30].spans == got[31].spans == got[32].spans == "" and got[0].n_spans == 1
    out = rows(pii.stage(spark, d.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("spans")), ""))
    assert out[21].text == texts[21].replace(secret(99), "[secret]") and out[32].text is None and out[21].spans == 2


def test_redaction_merges_overlapping_spans(spark):
    spans = F.from_json(F.lit('[{"kind":"email","s":2,"e":6},{"kind":"card","s":4,"e":9},{"kind":"ip","s":10,"e":11}]'), "array<struct<kind:string,s:int,e:int>>")
    assert spark.range(1).select(pii.redact(F.lit("0123456789abc"), spans)).first()[0] == "01[card]9[ip]bc"


def test_stages_on_odd_columns_and_missing_labels(spark):
    d = spark.createDataFrame([(1, "Haus und Wasser", None, 5, "x"), (1, "Haus und Wasser", None, 5, "x"), (None, "12 34", None, 6, "y"), (2, None, None, 7, "z"), (3, "", None, 8, "")], "doc_id long, text string, lang string, ids int, WHOLE string")
    assert langid.stage(spark, d, "").count() == 2 and langid.stage(spark, d.limit(0), "").count() == 0
    got = bpe.stage(spark, d, "")
    assert got.columns == ["doc_id", "lang", "ids", "n_tokens", "whole"] and got.count() == 5 and all(r.whole for r in got.collect())
    filled = langid.identified(d, langid.fit([("Haus und Wasser nicht", "de"), ("house and water not", "en")]))
    assert [r.lang for r in filled.collect()] == ["de", "de"]


def test_special_tokens_get_their_ids():
    data, off = common.flat(__import__("pyarrow").array(["x<|endoftext|>y z", "plain text"]))
    path = P.path("byte_bpe_50k.json")
    ids, cut = huffman.encode_flat(path, data, off)
    t = huffman.tokenizer(path)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in ("x<|endoftext|>y z", "plain text")] and 50256 in ids


def article(k, r):
    kinds = ["<p>{}</p>", "<div class='text-{n}'><p>{}</p></div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}<br><p>", "<h2 id=part{n}>{}</h2>", "<p>{} <span class='notice-period sharing-rules'>inline words</span></p>"]
    texts, html = [], []
    for j in range(r.randint(4, 9)):
        t, kind = prose(r.randint(12, 50), 10_000 + 31 * k + j), r.choice(kinds)
        html.append(kind.replace("{n}", str(j)).format(t))
        texts.append(t + (" inline words" if "inline" in kind else ""))
    return texts, "".join(html)


def test_generated_pages_give_their_articles(spark):
    r, data, want = random.Random(9), [], {}
    for k in range(60):
        texts, body = article(k, r)
        wrap = ["<article>{}</article>", "<div class='layout no-sidebar'><main>{}</main></div>", "<div id=content class='post comments-open'>{}</div>", "<div class=story-{n}><section>{}</section></div>"][k % 4].replace("{n}", str(k)).format(body)
        html = f"<html><head><title>t</title><style>p</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>buy this now</div>{wrap}<div class='comments'><p>I liked it very much</p></div><aside>more to read</aside><form><label>Your name</label></form><footer>the end</footer>"
        data.append((k, f"https://h{k % 4}.example/{k}", html))
        want[k] = "\n".join(texts)
    got = rows(pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id")
    assert {k: got[k].text for k in want} == want


@pytest.mark.parametrize("piece", ["<a ", "<a '", "<b>x", "<div>x", "<!", "<p><b>x", "<nav>x", "<td>x", "</p>", "<ul><li>x", "&amp;", "<script>", "<span class=ad>x.", "x. <span class=ad>x</span>"])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    pages.text_of(piece * 40_000, None)
    assert time.time() - began < 8


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    class Conf:
        def get(self, key, default=None):
            return default

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=Conf, master="spark://host:7077"), conf=Conf())
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(fake)


ARTICLE = "<p>Some words of an article that goes on for a while, with a second clause.</p>"
ARTICLE_TEXT = ARTICLE[3:-4]
COMMENTS = "".join(f"<p>Comment {k} has a text that is long enough to win any vote.</p>" for k in range(20))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article>{ARTICLE}</article><div class='comments'>{COMMENTS}</div>", ARTICLE_TEXT),
        (f"<div>{ARTICLE}</div><div id=comments>{COMMENTS}</div>", ARTICLE_TEXT),
        ("<nav><ul>" + "".join(f"<li>item number {k}</li>" for k in range(60)) + f"</ul></nav><div>{ARTICLE}</div>", ARTICLE_TEXT),
        ('<p>He gave <span class="notice">two weeks</span> and left.</p>', "He gave two weeks and left."),
        (f'<article><h2 class="header">Head</h2>{ARTICLE}</article>', f"Head\n{ARTICLE_TEXT}"),
        (f'<article>{ARTICLE}<div class="related"><p>It says more about it.</p></div></article>', f"{ARTICLE_TEXT}\nIt says more about it."),
        (f'<article>{ARTICLE}<div class="related"><a href=x>one thing</a> and <a href=y>another thing</a></div></article>', ARTICLE_TEXT),
        (f'<div class="notice"><article>{ARTICLE}</article></div><div>tiny</div>', ARTICLE_TEXT),
        ('<div class="notice">only this</div>', "only this"),
        ("<nav>only a menu</nav>", "only a menu"),
        (f"<form><h1>Head</h1>{ARTICLE}<div class='sidebar'>no</div></form><div>tiny</div>", f"Head\n{ARTICLE_TEXT}"),
        (f"<div>{ARTICLE}</div><form><p>Your name and what you think of it all</p></form>", ARTICLE_TEXT),
        (f'<div><p>{ARTICLE_TEXT} <span class="share">Share me</span></p></div>', ARTICLE_TEXT),
        ("<div>" * 60 + ARTICLE + "<nav>menu</nav>" + "</div>" * 60, ARTICLE_TEXT),
        ("<div>" * 40 + f"<div class='a'>{ARTICLE}</div><div class='b'><p>else</p></div>" + "</div>" * 40, ARTICLE_TEXT),
    ],
)
def test_furniture_of_a_lone_page(body, want):
    assert pages.text_of(f"<html><head><title>no</title></head><body>{body}</body></html>", None) == want


def test_long_comments_on_a_whole_host(spark):
    data = [(k, f"http://h.example/{k}", f"<body><div class='post-{k}'><h1>Title {k}</h1>{ARTICLE}</div><section class='comments'>{COMMENTS * (k % 3)}</section></body>") for k in range(12)]
    got = pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Title {k}\n{ARTICLE_TEXT}" for k in range(12)}


def test_very_long_pages_and_clashing_columns(spark):
    body = f"<article>{ARTICLE * 20000}</article>"
    rows = [(1, "http://a.example/", body, "p", 1.0, "h"), (2, None, None, "q", 2.0, None), (2, None, None, "q", 2.0, None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string, score double, host string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 20000 * (len(ARTICLE_TEXT) + 1) - 1), (2, 0), (2, 0)]
    deep = "<div>" * 100_000 + "deep" + "</div>" * 100_000
    assert pages.text_of(deep, None) == "deep"


def test_patterns_find_what_is_no_seed(spark):
    """Values that no seed has, of the seeds' shape and of others, come from the contexts that seeds share; hidden seeds come back."""
    r = random.Random(4)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    values = [hexa(40) for _ in range(40)] + ["hunter22", "open-sesame"]
    data = [(k, f"{prose(12, 500 + k)} api token = \"{v}\" {prose(12, 900 + k)} {hexa(40)}x") for k, v in enumerate(values)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(pii.report(docs))
    spans = {k: [(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[k].spans.split(",") if x] for k, t in data}
    assert all(("secret", v) in spans[k] for k, v in enumerate(values))
    assert all(len(spans[k]) == 1 for k in spans)  # tokens of the same shape elsewhere have no pattern that vouches for them
    seeds = spark.createDataFrame([(v,) for v in values[:40]], "v string").where(~pii._held_out(F.col("v"), "seed")).count()
    assert 15 < seeds < 40
    e = {x.kind: x for x in pii.evaluate(docs).collect()}["secret"]
    here = spark.createDataFrame([(v,) for v in values[:40]], "v string").where(pii._held_out(F.col("v"), "hide")).count()
    assert 0 < here == e.right < e.hidden and e.found == 42  # the other hidden tokens stand where no pattern vouches for them


def test_three_runs_of_a_family_give_what_one_run_gives(spark, tmp_path):
    r = random.Random(8)
    shared = [prose(90, 3000 + k) for k in range(6)]
    texts = [" ".join(r.choice([prose(40, 4000 + 7 * k + j), r.choice(shared)]) for j in range(4)) for k in range(45)] + ["", None, shared[0], shared[0], "short"]
    data = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("part", F.col("doc_id") % 3)
    want = sorted(tuple(x) for x in suffix.dedup(docs).collect())
    last, path = {}, str(tmp_path / "family")
    for part in range(3):
        got = suffix.extend(docs.where(F.col("part") == part), path).collect()
        assert {x.doc_id for x in got} >= {k for k, _ in data if k % 3 == part}
        by = {}
        for x in got:
            by.setdefault(x.doc_id, []).append(tuple(x))
        last |= by
    assert sorted(x for v in last.values() for x in v) == want and any(x[2] for x in want)
    assert [rank for rank, _ in suffix.Family(spark, path).levels] == [1, 0]


def test_fingerprints_of_repeated_long_rows(spark):
    text = " ".join(f"longword{k % 7}x{k % 3}" for k in range(3000))
    d = spark.createDataFrame([(1, text)] * 12 + [(2, text), (None, text), (None, text), (None, None)], "doc_id long, text string")
    got = simhash.compare(d).collect()
    assert len(got) == 16 and len({r.fingerprint for r in got if r.n_chars}) == 1
    assert sorted(str(r.doc_id) for r in got) == ["1"] * 12 + ["2"] + ["None"] * 3
    cut = text[: len(text) - len(text) // 4]
    assert {(r.n_chars, r.edited_sha256) for r in got if r.doc_id is None} == {(len(t), hashlib.sha256(e.encode()).hexdigest()) for t, e in ((text, cut), ("", ""))}


def test_token_ids_take_little_memory():
    import tracemalloc

    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=600)) for _ in range(1500)] + ["x" * 300_000 + " end"]
    data, off = common.flat(__import__("pyarrow").array(texts))
    path, got = P.path("byte_bpe_50k.json"), []
    t = huffman.tokenizer(path)
    tracemalloc.start()
    for i, j in common.slices(off, huffman._SLICE):
        ids, cut = huffman.encode_flat(path, data[off[i] : off[j]], off[i : j + 1] - off[i])
        got += [ids[a:b].copy() for a, b in zip(cut, cut[1:], strict=False)]
        del ids
    most = tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in got)
    tracemalloc.stop()
    assert len(data) > 5_000_000 and most < 120_000_000, most
    assert all(x.tolist() == t.encode(y, add_special_tokens=False).ids for x, y in zip(got[::50] + got[-1:], texts[::50] + texts[-1:], strict=True))


def test_words_of_passages_that_other_documents_hold(spark):
    """Passages of 45 to 60 words below 400 bytes, in other case and white space, twice in one document, in copies and in odd rows."""
    r, texts = random.Random(12), []
    vocabulary = [f"w{k}" for k in range(4000)]
    passages = [r.choices(vocabulary, k=80) for _ in range(4)]
    for k in range(60):
        n, at = r.choice((45, 49, 50, 51, 60)), r.randrange(20)
        part = [w.upper() if k % 3 else w for w in passages[k % 4][at : at + n]]
        texts.append((" ", "\n", " \t")[k % 3].join(r.choices(vocabulary, k=r.randrange(90)) + part + r.choices(vocabulary, k=r.randrange(70))))
    alone = " ".join(r.choices(vocabulary, k=60))
    texts += [f"{alone} x {alone}", texts[5], " ".join(passages[0][:50]), " ".join(passages[0][:49]), "a " * 300, "A\n" * 40 + "b", "a " * 50, "", None, " \n "]
    table = list(enumerate(texts)) + [(3, texts[3]), (None, " ".join(passages[1])), (500, " ".join(r.choices(vocabulary, k=70)))] + [(500, alone[::-1])] * 2
    of = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in table]
    holders = {}
    for row, w in zip(table, of, strict=True):
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(row)
    want = []
    for row, w in zip(table, of, strict=True):
        hit = {j for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
        want.append((row[0], len((row[1] or "").encode()), len(hit)))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = suffix.dedup(df, passage=50).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_shared_words) for x in got) == Counter(want) and sum(n > 0 for *_, n in want) > 30
    assert Counter(tuple(x)[:5] for x in got) == Counter(map(tuple, suffix.dedup(df).collect()))  # what is removed stays as it was
