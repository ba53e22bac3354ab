"""Main text of web pages by consensus host paths.

1. Each page scores its containers: blocks of text vote for the elements around them, links and page furniture
   count against them.
2. Spark adds up the scores per host and generalised tag-class path (digits in class names become one mark), and
   takes the best path of each host.
3. Each page is read again and the elements on its host's winning path give the text; a page without such an
   element uses its own best container.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fits_broadcast

#: Most winning paths that are broadcast; beyond that the join shuffles by host.
BROADCAST_HOSTS = 100_000
#: What text counts in an element whose class, id or role has a word of furniture.
DOUBT = 0.3
#: What a container's score is worth to the next one around it, and share of links in the text of a doubtful box that hides it.
DECAY, LINKS = 0.7, 0.5
#: Block elements that a path spells out; those further in are told apart by a hash of their names.
SPELT = 30

# Element names of HTML, and words of class names and ids that mark page furniture.
_RAW = "script style noscript template textarea iframe svg math object select title"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"html", "body"}
_SELF_CLOSING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FURNITURE = frozenset("nav header footer aside form button menu dialog head".split())
_BOXES = frozenset("popup promo promoted related respond share sharing social toolbar widget".split())  # furniture if full of links
_NOISE = _BOXES | frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header menu nav navbar navigation newsletter notice notices sidebar sponsor sponsored subscribe subscription".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    rf"|<(?P<raw>{'|'.join(_RAW.split())})(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NO_CONTAINER = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dd dt pre figcaption summary html".split())
_NEVER = frozenset("html body main article".split())
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")


class _Element:
    """An open element; path names the block elements from the root to it. gate: the innermost element from it outward that
    may be hidden, itself included."""

    __slots__ = ("block", "container", "depth", "doubtful", "free", "gate", "hidden", "kind", "links", "name", "parent", "path", "size")

    def __init__(self, name: str, label: str, parent: _Element | None, kind: str = "", doubtful: bool = False):
        self.name, self.parent, self.kind, self.size, self.links, self.hidden, self.free = name, parent, kind, 0, 0, 0, False
        self.block = name in _BLOCK
        self.depth = (parent.depth if parent else 0) + self.block
        above = parent.path if parent else ""
        if not self.block:
            self.path = above
        elif self.depth <= SPELT:
            self.path = f"{above}/{label}" if above else label
        else:  # as long as any other, so that time stays linear in the depth
            head, _, tail = above.partition("/~")
            self.path = f"{head}/~{hashlib.blake2b(f'{tail}/{label}'.encode(), digest_size=8).hexdigest()}"
        self.doubtful = doubtful or bool(parent and parent.doubtful)
        self.container = self.block and name not in _NO_CONTAINER
        self.gate = self if kind else parent.gate if parent else None


#: Why an element may be hidden, as bits: its names, its own name, the head.
_BY_NAME, _BY_ELEMENT, _HEAD = 1, 2, 4


def _kind(tag: str, names: list[tuple[str, str]]) -> tuple[str, bool]:
    """(what may hide the element: 'element', 'form', 'name', 'box', 'inline' or nothing; whether its names have a word of
    _NOISE at all).

    Element names hide whatever they enclose. Of the others only containers are hidden for a class, id or role that is a
    word of _NOISE as a whole: never a heading, a paragraph, a list item or a cell, and inline elements only between sentences."""
    if tag in _FURNITURE:
        return ("form" if tag == "form" else "element"), False
    if not names or tag in _NEVER:
        return "", False
    marks = {w.lower() for _, v in names for w in _WORDS.findall(v)} & _NOISE
    whole = {w for _, v in names for w in v.lower().split()} & marks
    if not whole or tag in _NO_CONTAINER:
        return "", bool(marks)
    return ("inline" if tag not in _BLOCK else "name" if whole - _BOXES else "box"), True


def _after_sentences(pieces: list[tuple[str, int, _Element | None]]) -> set[_Element]:
    """The named inline elements that end their block and begin after the end of a sentence, or are the whole block."""
    first: dict[_Element, str] = {}
    last: dict[_Element, int] = {}
    tail, before = -1, ""
    for k, (t, _, g) in enumerate(pieces):
        if g is not None and g.kind == "inline":
            first.setdefault(g, before)
            last[g] = k
        if t := t.rstrip():
            tail, before = k, t[-1]
    return {e for e, x in first.items() if last[e] >= tail and (not x or x in ".!?:;…»”\"")}


def blocks(page: str) -> list[tuple[str, int, _Element | None]]:
    """(text, characters in links, innermost element around it) of each block of a page outside furniture, in order.

    Hidden are elements that are furniture by their own name, containers named by a word of _NOISE unless they enclose an
    `article` or `main`, boxes whose text is mostly links, forms that enclose no `h1`, `article` or `main`, and named inline
    elements that stand after the last sentence of their block. Where nothing else on the page has text, named
    containers are shown, where there is still none, the others but named ones, and at last all but the head. Time is linear in the page's length, however
    deep elements nest and however many are left open."""
    raw: list = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    gates: list[_Element] = []
    text: list[tuple[str, int, _Element | None]] = []

    def flush():
        if text:
            raw.append((list(text), stack[-1] if stack else None))
            text.clear()

    def pop():
        opened[stack.pop().name] -= 1

    def close(names: set[str], within: set[str] = frozenset()) -> None:
        """Close the innermost open element of `names` and all in it, if no element of `within` is open inside it."""
        if not any(opened[n] for n in names):
            return
        at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name in names or stack[i].name in within)
        if stack[at].name in names:
            if any(e.block for e in stack[at:]):
                flush()
            while len(stack) > at:
                pop()

    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            t = m["text"]
            link, gate = opened["a"] > 0, stack[-1].gate if stack else None
            text.append((t, len(t) if link else 0, gate))
            if gate is not None:
                n = len(t.strip())
                gate.size += n
                gate.links += n if link else 0
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if not opened[tag]:
                if tag in _BLOCK:
                    flush()
            else:
                close({tag})
            continue
        if tag == "br":
            text.append((" ", 0, stack[-1].gate if stack else None))
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            while stack and not stack[-1].block and stack[-1].name != "a":  # inline elements end where a block begins
                pop()
        if tag in _ENDS_P:
            close({"p"})
        if tag in _SELF_CLOSING:
            close(_SELF_CLOSING[tag], {"ul", "ol", "dl", "table", "select"})
        if m["attrs"].endswith("/") and tag not in _BLOCK:
            continue
        parent = stack[-1] if stack else None
        names = [(a.lower(), b or c or d or "") for a, b, c, d in _NAMES.findall(m["attrs"])] if m["attrs"] else []
        hides, doubtful = _kind(tag, names)
        label = tag
        if tag in _BLOCK:
            cls = " ".join(v for k, v in names if k == "class")
            label += "".join("." + c for c in sorted(_DIGITS.sub("#", cls).split()))
        e = _Element(tag, label, parent, hides, doubtful and tag in _BLOCK)
        if hides:
            gates.append(e)
        if tag in ("article", "main", "h1"):
            g = e.gate
            while g is not None and g.kind != "element" and not (g.free and tag != "h1"):
                if tag != "h1":
                    g.free = True
                elif g.kind == "form":
                    g.free = True
                    break
                g = g.parent.gate if g.parent else None
        stack.append(e)
        opened[tag] += 1
    flush()
    outer = lambda e: e.parent.gate if e.parent else None
    for e in reversed(gates):  # inner ones first: a box counts what is in it as a whole
        if (o := outer(e)) is not None:
            o.size += e.size
            o.links += e.links
    for e in gates:  # outer ones first
        o = outer(e)
        named = e.kind == "name" or (e.kind == "box" and e.links >= LINKS * max(1, e.size))
        own = _HEAD if e.name == "head" else _BY_ELEMENT if e.kind == "element" else 0 if e.free else _BY_ELEMENT if e.kind == "form" else _BY_NAME if named else 0
        e.hidden = own | (o.hidden if o is not None else 0)
    for shown in (0, _BY_NAME, _BY_ELEMENT, _BY_NAME | _BY_ELEMENT):
        out = []
        for pieces, around in raw:
            loose = _after_sentences(pieces)
            seen = [(t, n) for t, n, g in pieces if g is None or (not g.hidden & ~shown and g not in loose)]
            t = _SPACES.sub(" ", _html.unescape("".join(t for t, _ in seen))).strip()
            if t:
                out.append((t, sum(n for _, n in seen), around))
        if out:
            return out
    return []


def scores(found: list[tuple[str, int, _Element | None]]) -> dict[str, float]:
    """Score of each container path: text outside links, less with each container between block and container, and less in
    elements whose names have a word of _NOISE."""
    gains: dict[_Element, float] = {}
    for text, links, e in found:
        if e is not None:
            gains[e] = gains.get(e, 0.0) + max(0, len(text) - 2 * links) * (DOUBT if e.doubtful else 1)
    order, known = [], set(gains)
    for e in gains:  # all elements around blocks
        up = e.parent
        while up is not None and up not in known:
            known.add(up)
            order.append(up)
            up = up.parent
    levels = {}
    for e in [*gains, *order]:
        way = []
        while e is not None and e not in levels:
            way.append(e)
            e = e.parent
        n = levels[e] if e is not None else 0
        for x in reversed(way):
            n += 1
            levels[x] = n
    out: dict[str, float] = {}
    for e in sorted(levels, key=levels.get, reverse=True):
        gain = gains.get(e, 0.0)
        if e.container:
            out[e.path] = out.get(e.path, 0) + gain * (1.3 if e.name in ("article", "main") else 1)
            gain *= DECAY
        if e.parent is not None:
            gains[e.parent] = gains.get(e.parent, 0.0) + gain
    return out


def best(found: list) -> str | None:
    """The container path with the highest score; ties go to the smaller path."""
    s = scores(found)
    return max(sorted(s), key=s.get) if s else None


def under(found: list, path: str) -> list[str]:
    """Texts of the blocks inside an element on `path`."""
    known: dict[int, bool] = {}

    def inside(e: _Element | None) -> bool:
        way = []
        while e is not None and id(e) not in known and e.path != path:
            way.append(e)
            e = e.parent
        got = e is not None and known.get(id(e), True)
        for x in way:
            known[id(x)] = got
        return got

    return [t for t, _, e in found if inside(e)]


def text_of(page: str | None, path: str | None) -> str:
    """The text of `page` under `path`, or under its own best container where it has no such element; empty if none."""
    found = blocks(page or "")
    got = under(found, path) if path else []
    if not got and (own := best(found)):
        got = under(found, own)
    return "\n".join(got or [t for t, _, _ in found])


def host(url):
    """Lower-case host of a url column, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, score, pages): scores of container paths, each page's scores scaled to add up to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[float]] = {}
        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = scores(blocks(page or ""))
                whole = sum(s.values())
                for path, x in s.items():
                    if whole:
                        got = total.setdefault((h, path), [0.0, 0])
                        got[0] += x / whole
                        got[1] += 1
            if len(total) > 50_000:
                yield batch(total)
                total = {}
        yield batch(total)

    def batch(total):
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array([x for x, _ in total.values()], pa.float64()), pa.array([int(n) for _, n in total.values()], pa.int64())], ["host", "path", "score", "pages"])

    rows = pages.select(host(F.col(url)).alias("host"), html).mapInArrow(run, "host string, path string, score double, pages long")
    return rows.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))


def winners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path with the highest score on each host; ties go to the smaller path."""
    v = votes(pages, url, html).withColumn("score", F.round("score", 6))
    return v.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), -F.col("pages"), "path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars, path for each row. Null html gives empty text; null and odd urls share the host ''.

    Repeated rows give repeated rows. An empty table gives no rows."""
    won = durable(winners(pages, url, html))
    if fits_broadcast(won, BROADCAST_HOSTS):
        won = F.broadcast(won)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"), host(F.col(url)).alias("host")).join(won, "host", "left").select("k", "u", "h", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [text_of(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), b.column(3)], [key, url, "text", "n_chars", "path"])

    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars long, path string")
