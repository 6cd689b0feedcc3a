"""Exact copies, near copies and repeated bytes, against brute force."""

import random
import re
from collections import defaultdict

import pytest

from segmentlab.llm import jaccard, radix
from segmentlab.llm.components import components


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[plain(text)].append((doc_id, len(text or "")))
    out = []
    for members in groups.values():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(doc_id, best[0], len(members)) for doc_id, _ in members]
    return sorted(out, key=str)


ROWS = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "a "), (6, " a\t"), (7, "ab"), (8, "b"), (9, "é" * 400), (10, "é " * 400),
        (11, "é" * 399 + "e"), (12, "x" * 100_000), (13, "x" * 100_001), (14, "x " * 100_000), (None, "null id"), (None, "nullid"),
        (15, "same"), (15, "same"), (16, "same"), (17, "\x0b\x0csame\r")]


@pytest.mark.parametrize("width,growth", [(1, 2), (3, 4), (64, 4)])
def test_radix_groups(docs, width, growth):
    rng = random.Random(5)
    rows = ROWS + [(100 + i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    got = radix.exact_dedup(docs(rows), width, growth).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == brute_exact(rows)
    # One row of each group is kept, also among fully equal rows.
    assert sum(r.kept for r in got) == len({plain(t) for _, t in rows})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_radix_drops_copies_and_keeps_columns(docs):
    df = docs(ROWS)
    kept = radix.drop_copies(df)
    assert kept.columns == df.columns
    assert len({plain(r.text) for r in kept.collect()}) == kept.count() == len({plain(t) for _, t in ROWS})


def test_empty_tables(docs):
    assert radix.exact_dedup(docs([])).collect() == []
    assert radix.drop_copies(docs([])).collect() == []
    assert jaccard.ngram_join(docs([])).collect() == []


def brute_join(rows, size=4, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_rows(seed, groups=12, copies=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(15))
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "Ä b c d"), (8, "ä b c d"),
            (9, "a b " * 5000), (10, "a b " * 4000)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for c in range(copies):
            text = base[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((1000 * g + c + 20, " ".join(text) + (" " + shared if g % 2 else "")))
    return rows + rows[-3:]


@pytest.mark.parametrize("hot,free,pivots,fragments", [(16, 16, 4, 4), (2, 2, 1, 3), (100, 3, 2, 2), (0, 1, 1, 1)])
def test_jaccard_join(docs, monkeypatch, hot, free, pivots, fragments):
    # Small limits force hot shingles, pivots, and the second round between components.
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "FREE", free)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "FRAGMENTS", fragments)
    rows = near_rows(hot)
    got = jaccard.ngram_join(docs(rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_join(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(-5, 7), (200, 200)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                want.setdefault(x, {x})
            both = want[a] | want[b]
            for x in both:
                want[x] = both
    assert got == {x: min(s) for x, s in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
