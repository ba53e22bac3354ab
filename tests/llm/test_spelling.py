"""Spelling variants against a brute-force version that tries every deletion of every word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from brindle.llm import spelling

R = random.Random(5)


def plain(rows):
    """word: (form, root, n, n_near, form_n) of (doc_id, text) rows."""
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            gaps[short, k].add(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def changed(w):
    k, how = R.randrange(len(w)), R.randrange(3)
    return w[:k] + w[k + 1 :] if how == 0 else w[:k] + R.choice("abcdéÀ") + w[k + (how == 1) :]


@pytest.fixture(scope="module")
def corpus():
    base = ["".join(R.choice("abcdéÿ") for _ in range(R.randint(4, 10))) for _ in range(150)]
    words = base + [changed(R.choice(base)) for _ in range(1200)]
    text = lambda: " ".join(R.choice(words[: R.choice([40, 300, 1350])]).replace("a", "A") for _ in range(R.randint(0, 700)))
    rows = [(k, text()) for k in range(50)]
    odd = [(None, "hellos hellos hellos hellox " * 3), (99, None), (100, ""), (101, "x" * 5000 + " " + "y" * 70 + " ×÷αα 12"), (101, "hellos"), (101, "hellos")]
    return rows + odd + [(200, " ".join(R.choice(words) for _ in range(60000)))]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def test_variants_as_plain(spark, corpus):
    assert got(spark, corpus) == plain(corpus)


def test_large_blocks_are_subdivided(spark, corpus, monkeypatch):
    """Blocks of any size give the same result, and every near pair once."""
    monkeypatch.setattr(spelling, "MOST", 4)
    assert got(spark, corpus) == plain(corpus)


def test_no_documents(spark):
    assert got(spark, []) == {}


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["abcdefg"] * 40 + ["abcdef"] * 13 + ["abcde"] * 4 + ["abxde"] * 3 + ["zzzzz"] * 3)
    out = got(spark, [(None, text)])
    assert out["abcde"][:2] == ("abcdef", "abcdefg") and out["abcdefg"][:2] == (None, "abcdefg")
    assert out["abxde"][0] is None and out["abxde"][3] == 1  # 4 is less than twice 3
    assert out["zzzzz"] == (None, "zzzzz", 3, 0, None)
