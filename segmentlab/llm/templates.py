"""HTML extraction by equivalence-class template deduction.

Pages of one host are cut into tokens: tags with the path that leads to them, and pieces of text
with theirs. A token's occurrence vector tells how often it occurs in each page of the host. Tokens with the
same vector form an equivalence class. A class is valid if it is large and frequent enough, if
its tokens keep their order in every page, and if it nests: each of its tokens lies under a path whose own
token is in the template. Tokens of valid classes are the template of the host; what lies
between them are slots.

The text of a page is what its slots hold outside menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles: inside the article or main element where the page has one with
text; otherwise all slots that are not mostly links. Text of the template is no slot, inside an article
too; only headings stay there, and articles that are template text for more than half, as these are
copies of one article. A marked element around the main element, or around the longest article where
no article lies outside marked ones, is a wrapper of the page and not beside the text. Names mark an element
only as whole words of a class: ``sidebar`` and ``sidebar-left`` do, ``no-sidebar`` does not.
Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines.

Vectors are compared by order-free sums of hashes, so a host with any share of the pages is never
gathered in one place. Templates are broadcast if their counted size is under ``BROADCAST`` tokens, and
joined by host beyond that. Absent and empty pages give an empty text, an empty table no rows; pages without a
url form one host; rows that repeat are extracted each; of equally long articles the first counts. Reading
takes time in proportion to the page, however its tags nest or fail to close; a tag whose quotes never
close ends at the next ``>``, and so do all after it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.session import written

#: Pages that a class must occur in, its share of the host's pages, and its number of tokens.
SUPPORT, SHARE, CLASS = 3, 0.5, 3
#: Tokens of all templates up to which they are broadcast (8 bytes each).
BROADCAST = 4_000_000

#: Elements whose content is no text of the page, and those that never close.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "select", "option", "svg", "math", "object", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are beside the text wherever they stand, and outside an article.
BESIDE = frozenset("nav footer aside form button menu dialog select label fieldset head".split())
BESIDE_OUTSIDE = frozenset(("header",))
#: Elements that do not break a block.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark content beside the text, and words of place or form that may stand with them.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
menu breadcrumb breadcrumbs sidebar footer masthead comment comments reply replies respond disqus cookie cookies consent gdpr
notice notices alert announcement disclaimer notification notifications newsletter subscribe subscription signup login social share sharing related recommended recommendations
popup modal overlay search pagination pager widget toolbar tags complementary contentinfo outbrain taboola""".split())
MARKS_OUTSIDE = frozenset("header hero".split())
PLAIN = frozenset("""area bar block body bottom box buttons bttn btn col column container content entry first fixed float footer form global
group header icons inner inline item items left line link links list main message middle outer page panel post posts articles stories
primary reader right row secondary section site slot small sticky strip text title top unit user users view widget wrap wrapper""".split())

_START = re.compile(r"<(?=[!?]|/?[A-Za-z])")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_UNQUOTED = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Words of a class, and the parts of words in camel case.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_CLOSES_P = frozenset("""address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre
section table ul""".split())


_BARRIERS = ("ul", "ol", "table", "div", "article", "section")


class Block(NamedTuple):
    """A block of text: words without references, number of its path and of the one above, whether it lies in an article,
    beside the text, in a heading, and how much of it is links."""
    text: str
    path: int
    above: int
    article: bool
    beside: bool
    heading: bool
    links: int

    @property
    def token(self) -> int:
        return number(self.path, "|" + self.text)


class _Open(NamedTuple):
    """An open element: ``place`` is the path, the path above and the heading flag of the block it belongs to; ``side``
    the article, the innermost marked element and the hidden flag that hold for its text."""
    name: str
    path: int
    place: tuple[int, int, bool]
    side: tuple[int, int, bool]


def number(above: int, label: str) -> int:
    """64-bit number of a token below the path of number ``above`` (0 at the top)."""
    return int.from_bytes(blake2b(above.to_bytes(8, "little", signed=True) + label.encode(), digest_size=8).digest(), "little", signed=True)


def marked(value: str, marks: frozenset[str]) -> bool:
    """Does a word of a class, id or role consist of marking words, and words of place or form beside them?"""
    for word in value.split():
        parts = [p.lower() for p in _PARTS.findall(word) if len(p) > 1]
        if "".join(parts) in marks or (not marks.isdisjoint(parts) and all(p in marks or p in PLAIN for p in parts)):
            return True
    return False


def _tokens(html: str) -> Iterator[tuple[str, re.Match | None, int]]:
    """(text before, tag, end of the tag) in page order, and the rest. Send a place to go on there, after raw content."""
    at, last, pattern = 0, html.rfind(">") + 1, _TAG
    while start := _START.search(html, at, last):
        begin = start.start()
        if html[begin + 1] in "!?":
            m = _ASIDE.match(html, begin)
            yield html[at:begin], None, m.end()
            at = m.end()
            continue
        m = pattern.match(html, begin)
        if m is None:
            pattern = _TAG_UNQUOTED  # quotes are never closed: no tag is scanned to the end twice
            m = pattern.match(html, begin)
        moved = yield html[at:begin], m, m.end()
        at = m.end() if moved is None else moved
    yield html[at:].partition("<!--")[0], None, len(html)


def parse(html: str | None) -> tuple[list[tuple[int, int]], list[Block]]:
    """Tags of a page as numbers of their paths and of those above, and its blocks, both in page order."""
    tags: list[tuple[int, int]] = []
    found: list[tuple] = []
    html = html or ""
    root = _Open("", 0, (0, 0, False), (0, 0, False))
    stack, parts, place, side = [root], [], root.place, root.side
    where: dict[str, list[int]] = defaultdict(list)  # depths of open elements by name
    around = [0]  # the marked element around each marked element
    wraps: set[int] = set()  # marked elements that hold the text of the page
    articles: dict[int, tuple[int, int, bool]] = {}
    links = 0

    def close() -> None:
        nonlocal parts, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((text, place, side, links))
        parts, links = [], 0

    def add(piece: str) -> None:
        nonlocal place, side, links
        if piece:
            top = stack[-1]
            if top.side != side:
                close()  # an inline element may lie beside the text too
            if not parts:
                place, side = top.place, top.side
            parts.append(piece)
            if any(o.name == "a" for o in stack[-3:]):
                links += len(piece)

    def leave(depth: int) -> bool:
        """Take elements from ``depth`` on away; was one below the first not inline?"""
        broken = False
        while len(stack) > depth:
            o = stack.pop()
            where[o.name].pop()
            broken = broken or (len(stack) > depth and o.name not in INLINE)
        return broken

    def unwrap(mark: int) -> None:
        while mark and mark not in wraps:
            wraps.add(mark)
            mark = around[mark]

    tokens, moved = _tokens(html), None
    while True:
        try:
            before, m, end = tokens.send(moved)
        except StopIteration:
            break
        moved = None
        add(before)
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                close()
            if where[name] and leave(where[name][-1]):
                close()
            continue
        top = stack[-1]
        if name == "br":
            add(" ")
            tags.append((number(top.path, ">br"), top.path))
            continue
        if name not in INLINE:
            close()
            if name in _CLOSES_P or name == "li":
                own = where["li" if name == "li" else "p"]
                if own and not any(where[b] and where[b][-1] > own[-1] for b in _BARRIERS):
                    leave(own[-1])
        top = stack[-1]
        own = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        article, mark, hidden = top.side
        if name in ("article", "main") or "main" in own.get("role", ""):
            article = article or len(articles) + 1
        beside = name not in ("main", "body", "html") and (
            (name in BESIDE or any(marked(v, MARKS) for v in own.values()))
            or (not article and (name in BESIDE_OUTSIDE or any(marked(v, MARKS_OUTSIDE) for v in own.values()))))
        if beside:
            around.append(mark)
            mark = len(around) - 1
        elif article and (name == "main" or "main" in own.get("role", "")):
            unwrap(mark)
        hidden = hidden or bool(m[3] and name not in ("body", "html") and _HIDDEN.search(m[3]))
        now = (article, mark, hidden)
        if article:
            articles.setdefault(article, now)
        path = number(top.path, f">{name}" + (f".{own['class']}" if "class" in own else ""))
        tags.append((path, top.path))
        if name in _RAW_END and not m[0].endswith("/>"):
            raw = _RAW_END[name].search(html, end)
            moved = raw.end() if raw else len(html)
        elif name not in VOID and not m[0].endswith("/>"):
            where[name].append(len(stack))
            stack.append(_Open(name, path, top.place if name in INLINE else (path, top.path, name in HEADINGS), now))
    close()

    # The longest article that lies in marked elements shows the wrappers of a page without another article.
    sizes: dict[int, int] = defaultdict(int)
    for text, _, at, _ in found:
        if at[0] and at == articles[at[0]] and not at[2]:
            sizes[at[0]] += len(text)
    if sizes and all(articles[a][1] and articles[a][1] not in wraps for a in sizes):
        unwrap(articles[max(sizes, key=lambda a: (sizes[a], -a))][1])
    return tags, [Block(text, path, above, bool(article), hidden or (mark > 0 and mark not in wraps), heading, n)
                  for text, (path, above, heading), (article, mark, hidden), n in found]


def page_tokens(html: str | None) -> tuple[list[int], list[int]]:
    """Tokens of a page, tags before text, and for each the tag around its element (0 at the top)."""
    tags, blocks = parse(html)
    return [t for t, _ in tags] + [b.token for b in blocks], [a for _, a in tags] + [b.above for b in blocks]


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _occurrences(pages: DataFrame) -> DataFrame:
    """(host, page, token, above, times, first): what each page holds, once per token."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "token", "above", "times", "first"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                columns: list[list] = [[], [], [], [], []]
                hosts = []
                for host, page, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    own, above = (np.array(n, "int64") for n in page_tokens(html))
                    token, first, times = np.unique(own, return_index=True, return_counts=True)
                    hosts += [host] * len(token)
                    for column, values in zip(columns, (np.full(len(token), page), token, above[first], times, first)):
                        column.append(values)
                if hosts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hosts), *(pa.array(np.concatenate(c).astype("int64")) for c in columns)], names)

    slim = pages.select(_host().alias("host"), F.monotonically_increasing_id().alias("page"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(emit, "host string, page long, token long, above long, times long, first long")


def deduce_templates(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, least: int = CLASS) -> DataFrame:
    """(host, token) of the template of each host."""
    seen = written(_occurrences(pages), "tokens")
    vectors = seen.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(F.xxhash64("page", "times") % (1 << 40)).alias("a"), F.bit_xor(F.xxhash64("times", "page")).alias("b"),
        F.min("above").alias("above"))
    size = seen.groupBy("host").agg(F.count_distinct("page").alias("all"))
    frequent = vectors.where(F.col("pages") >= support).join(size, "host").where(F.col("pages") >= F.col("all") * share)
    classes = frequent.groupBy("host", "pages", "a", "b").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    member = written(frequent.join(classes, ["host", "pages", "a", "b"]).select("host", "token", "above", "a", "b"), "classes")
    # Order: places relative to the class's first token must not cross; each token keeps its rank in every page.
    placed = seen.select("host", "page", "token", "first").join(member, ["host", "token"])
    ranked = placed.groupBy("host", "page", "a", "b").agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("t"))
    ranks = ranked.select("host", "a", "b", F.posexplode("t").alias("rank", "t")).groupBy("host", "a", "b", F.col("t.token").alias("token")).agg(
        F.min("rank").alias("low"), F.max("rank").alias("high"))
    ordered = ranks.where("low = high").join(member.select("host", "token", "above"), ["host", "token"]).select("host", "token", "above")
    # Nesting: a token's own path is in the template too, or it stands at the top.
    inside = ordered.select("host", F.col("token").alias("above"))
    return ordered.where(F.col("above") == 0).select("host", "token").unionByName(
        ordered.join(inside, ["host", "above"], "left_semi").select("host", "token")).distinct()


def main_text(html: str | None, template: np.ndarray) -> str:
    """Text of a page, given the sorted numbers of its host's template tokens."""
    _, blocks = parse(html)
    slots = [b for b in blocks if not b.beside]
    inside = [b for b in slots if b.article]
    of = inside or slots
    known = np.isin(np.array([b.token for b in of], "int64"), template, assume_unique=False).tolist() if len(template) and of else [False] * len(of)
    if inside:
        repeated = sum(len(b.text) for b, k in zip(of, known) if k and not b.heading)
        copy = 2 * repeated > sum(len(b.text) for b in of if not b.heading)
        kept = [b for b, k in zip(of, known) if copy or b.heading or not k]
    else:
        kept = [b for b, k in zip(of, known) if not k and 2 * b.links <= len(b.text)]
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    templates = written(deduce_templates(pages), "templates")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), _host().alias("host"))
    names = ["page_id", "url", "text", "n_chars"]
    none = np.zeros(0, "int64")

    def done(part: pa.RecordBatch, tokens) -> pa.RecordBatch:
        texts = [main_text(h, t) for h, t in zip(part.column(2).to_pylist(), tokens)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    if templates.count() <= broadcast:
        numbers = templates.select("host", "token").toArrow().to_pandas()
        by_host = {host: np.sort(group.to_numpy()) for host, group in numbers.groupby("host")["token"]}
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    yield done(part, [shared.value.get(h, none) for h in part.column(3).to_pylist()])
        placed = slim
    else:
        per_host = templates.groupBy("host").agg(F.collect_list("token").alias("tokens"))
        placed = slim.join(per_host, "host", "left").select("page_id", "url", "html", "tokens")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    yield done(part, [np.array(t or (), "int64") for t in part.column(3).to_pylist()])
    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
