"""Benchmark leaks by tiling, and text of pages by templates."""

import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from segmentlab.llm import decontam, templates

WORDS = [f"w{i}" for i in range(2000)]


def brute_tiles(item, doc, least):
    """Greedy string tiling as published: mark the longest free matches until none of ``least`` tokens is left."""
    mi, md, total = set(), set(), 0
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and p + k not in mi and t + k not in md:
                    k += 1
                if k > best:
                    best, found = k, [(p, t)]
                elif k == best and k >= least:
                    found.append((p, t))
        if best < least:
            return total
        for p, t in found:
            if not any(p + i in mi or t + i in md for i in range(best)):
                mi.update(range(p, p + best))
                md.update(range(t, t + best))
                total += best


def test_tiles_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        doc = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        got = decontam.tiles(np.array(item, "uint64"), np.array(doc, "uint64"), 3)
        for p, t, k in got:
            assert item[p:p + k] == doc[t:t + k]
        if len(item) >= 3:
            # Ties between equal lengths may be marked in another order, so coverage may differ by less than a tile.
            assert abs(sum(k for *_, k in got) - brute_tiles(item, doc, 3)) < 3 + 3


def leak_case(rng):
    items = [[rng.choice(WORDS) for _ in range(n)] for n in (40, 30, 60, 3)]
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    whole = prose(50) + items[0] + prose(50)
    reordered = prose(10) + items[2][40:] + prose(7) + items[2][:20] + prose(5) + items[2][20:40]
    half = prose(20) + items[1][:10] + prose(20)
    short = prose(5) + items[3] + prose(5)
    rows = [(1, " ".join(whole)), (2, " ".join(reordered)), (3, " ".join(half)), (4, " ".join(short)), (5, " ".join(prose(300))),
            (6, None), (7, ""), (8, " ".join(prose(30_000) + items[0])), (None, " ".join(items[1])), (1, " ".join(whole)), (9, " ".join(whole).upper())]
    return items, rows


def test_leaks(spark, docs):
    items, rows = leak_case(random.Random(9))
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (77, None), (78, ""), (None, "a b c d e f")], "item_id long, text string")
    df = docs(rows)
    got = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 2), (4, 3), (8, 0), (9, 0), (None, 1)], key=str)
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7]
    assert decontam.leaks(docs([]), bench).collect() == []
    assert decontam.leaks(df, bench.limit(0)).collect() == []


def page(body, article="<article><h1>Head &amp; line</h1><p>First  para<br>more\n text</p><p>Second <b>bold</b> one</article>"):
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav>{article}{body}<footer>&copy; us</footer></body></html>")


EXTRAS = ["<aside>side</aside>", "<div class='sidebar'><p>side</p></div>", "<div id='cookie-notice'>We use cookies</div>", "<form>Name <input></form>",
          "<section class=comments><article class='comment'><p>Nice!</p></article></section>", "<div class=\"ad\">Buy</div>", "<!-- hidden > note -->",
          "<noscript>No</noscript>", "<header>Site</header>", "<div hidden>gone</div>", "<div class='readerComments'>So true</div>", "<ul id=sideBar><li>x</ul>", "<p class='site-notice'>Closed</p>"]
WANT = "Head & line\nFirst para more text\nSecond bold one"


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_pages(spark, broadcast):
    rows = [(i, f"http://h{i % 2}.example.org/{i}", page(x)) for i, x in enumerate(EXTRAS)]
    rows += [(100 + i, f"http://h{i % 2}.example.org/x{i}", page("", "<article><p>in " + x + " out</p></article>")) for i, x in enumerate(EXTRAS)]
    # Without an article: what all pages of the host share is template, the rest is text.
    rows += [(200 + i, "http://plain.example.org/", f"<html><body><div class=top>Welcome back</div><div><p>Story {i} here</p></div><div><a href=x>link {i}</a></div></body>") for i in range(6)]
    rows += [(300, None, None), (301, "", ""), (None, "x", "<p>only"), (302, "http://h0.example.org", "no tags &lt;3"), (303, "u", "<p>" + "long " * 50_000)]
    rows += rows[:2]
    pages = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], "page_id long, url string, html string, text string, host int, token string")
    got = templates.extract(pages, broadcast).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(len(EXTRAS)):
        assert text[i] == WANT, EXTRAS[i]
        assert text[100 + i].replace("\n", " ") == ("in Site out" if "header" in EXTRAS[i] else "in out"), EXTRAS[i]
    for i in range(6):
        assert text[200 + i] == f"Story {i} here"
    assert (text[300], text[301], text[None], text[302], text[303]) == ("", "", "only", "no tags <3", ("long " * 50_000).strip())


def test_equivalence_classes(spark):
    pages = spark.createDataFrame([(i, "http://a.b/c", f"<html><body><div class=m><p>Same line</p><p>own {i}</p></div><ul>{'<li>x</li>' * i}</ul></body></html>") for i in range(1, 6)],
                                  "page_id long, url string, html string")
    tokens = {r.token for r in templates.deduce_templates(pages).collect()}

    def number(*labels):
        above = 0
        for label in labels:
            above = templates.number(above, label)
        return above

    body = (">html", ">body")
    assert {number(*t) for t in (body[:1], body, (*body, ">div.m"), (*body, ">div.m", ">p", "|Same line"))} <= tokens
    # Two paragraphs in every page and a changing number of items are other vectors.
    assert number(*body, ">ul", ">li") not in tokens and number(*body, ">div.m", ">p", "|own 1") not in tokens


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert templates.extract(none).collect() == []


@pytest.mark.parametrize("html", [
    "<div class='page no-sidebar'><article><p>x y</p></article></div>", "<form id=aspnetForm><main><p>x y</p></main></form>",
    "<div id='main-menu-wrapper'><article>x y</article></div>", "<div class='has-header-ad'><main>x y</main></div>",
    "<div class='layout with-sidebar'><article>x y</article></div>", "<article class='post tags-news'>x y</article>",
    "<article><p class='share-price'>x y</p></article>", "<article><p class='related-work'>x y</p></article>", "<main><p class='alert-free'>x y</p></main>",
    "<div class=sidebar><article>x y</article></div><div class=comments><article class=comment>no</article></div>",
    "<article>x y<section class=comments><article class=comment>a long comment</article></section></article>",
    "<aside class='related-posts'><article>a long teaser of another page</article></aside><article>x y</article>",
    "<div class=siteFooter>no</div><div class='ad-slot-2'>no</div><ul id=sidebar-left><li>no</ul><main>x y</main>",
    "<article>x y<div class='newsletter-box'>no</div><p style='display: none'>no</p></article>"])
def test_wrappers_and_names(html):
    assert templates.main_text(html, np.zeros(0, "int64")) == "x y"


def brute_template(pages):
    """Template of one host from (token, above) of each page in order, by whole vectors and dictionaries."""
    counts = [Counter(t for t, _ in p) for p in pages]
    above = defaultdict(set)
    for p in pages:
        for t, a in p:
            above[t].add(a)
    groups = defaultdict(list)
    for t in above:
        vector = tuple(c[t] for c in counts)
        if sum(n > 0 for n in vector) >= max(templates.SUPPORT, len(pages) * templates.SHARE):
            groups[vector].append(t)
    ordered = set()
    for tokens in (g for g in groups.values() if len(g) >= templates.CLASS):
        ranks = defaultdict(set)
        for p, c in zip(pages, counts):
            if c[tokens[0]]:
                first = {}
                for at, (t, _) in enumerate(p):
                    first.setdefault(t, at)
                for rank, t in enumerate(sorted(tokens, key=first.get)):
                    ranks[t].add(rank)
        ordered |= {t for t, r in ranks.items() if len(r) == 1}
    return {t for t in ordered if min(above[t]) == 0 or min(above[t]) in ordered}


class Plain(HTMLParser):
    """Paragraphs and headings of the article of a well-formed page, in order."""
    def __init__(self, html):
        super().__init__()
        self.inside, self.blocks = 0, []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.inside and tag in ("p", "h1", "div"):
            self.blocks.append([tag, ""])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and data.strip():
            self.blocks[-1][1] += data


def test_template_against_brute_force(spark):
    """Random hosts: notices of any class that a host repeats inside its articles go, copies of whole articles stay."""
    rng, rows, want = random.Random(5), [], {}
    for host in range(6):
        notice, n = " ".join(rng.choices(WORDS, k=rng.choice([3, 60]))), rng.randint(4, 12)
        same = " ".join(rng.choices(WORDS, k=200)) if host == 5 else None
        for i in range(n):
            own = [same or " ".join(rng.choices(WORDS, k=rng.randint(90, 150))) for _ in range(rng.randint(1, 4) if not same else 1)]
            parts = [f"<p>{t}</p>" for t in own]
            parts.insert(host % 2 * len(parts), f"<div class=x{host}>{notice}</div>")
            html = f"<html><body><nav><ul>{'<li>m</li>' * rng.randint(1, 3)}</ul></nav><article><h1>Same head</h1>{''.join(parts)}</article><footer>f</footer></body></html>"
            page_id = host * 100 + i
            rows.append((page_id, f"http://h{host}/", html))
            kept = [(t, x) for t, x in Plain(html).blocks]
            assert ("div", notice) in kept
            want[page_id] = "\n".join(x for t, x in kept if same or t != "div")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(set)
    for r in templates.deduce_templates(pages).collect():
        got[r.host].add(r.token)
    for host in range(6):
        assert got[f"h{host}"] == brute_template([list(zip(*templates.page_tokens(h))) for p, _, h in rows if p // 100 == host]), host
    assert {r.page_id: r.text for r in templates.extract(pages).collect()} == want
