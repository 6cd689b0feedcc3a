"""All links of near copies, against brute force."""

import random

import pytest

from segmentlab.llm import jaccard, links


def shingle_set(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    return {" ".join(w)} if 0 < len(w) < size else {" ".join(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    """Links between classes, and per row its class, class size, linked classes and linked rows."""
    sets = [frozenset(shingle_set(t, size)) for _, t in rows]
    ids = {s: min((d for (d, _), o in zip(rows, sets) if o == s and d is not None), default=None) for s in sets}
    sizes = {s: sets.count(s) for s in ids}
    linked = {s: [o for o in ids if o != s and s and o and 100 * len(s & o) >= percent * len(s | o)] for s in ids}
    pairs = sorted((ids[s], ids[o], len(s), len(o), len(s & o)) for s in ids for o in linked[s] if ids[s] < ids[o])
    counts = [(d, ids[s], sizes[s], len(linked[s]), sum(sizes[o] for o in linked[s]) + sizes[s] - 1) if s else (d, d, 1, 0, 0) for (d, _), s in zip(rows, sets)]
    return pairs, sorted(counts, key=str)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (3, 50), (2, 100)])
def test_links_against_brute_force(spark, docs, size, percent):
    rng, rows = random.Random(size), [(900, None), (901, ""), (902, " \n"), (903, "Short text"), (904, "short  TEXT"), (905, "short text two")]
    for group in range(5):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([6, 40, 120]))]
        for k in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
            rows.append((group * 100 + k, " ".join(words + base[:rng.choice([0, 0, 3, 20])])))
    rows += [rows[-1], (None, rows[-2][1]), (None, "short text two")]
    df = docs(rows).repartition(5)
    pairs, counts = brute(rows, size, percent)
    assert sorted(tuple(r) for r in links.links(df, size, percent).select("a", "b", "n_a", "n_b", "overlap").collect()) == pairs
    got = links.link_counts(df, size, percent).select("doc_id", "class_id", "class_size", "n_classes", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == counts


@pytest.mark.parametrize("size, percent", [(4, 85), (3, 50)])
def test_groups_and_their_links(spark, docs, size, percent):
    rng, rows = random.Random(7), [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    for group in range(4):
        text = [f"w{rng.randrange(90)}" for _ in range(60)]
        for k in range(20):  # a chain: each member changes its predecessor, so ends of a group need not link
            text[rng.randrange(60)] = f"x{group}_{k}"
            rows.append((group * 100 + k, " ".join(text)))
    df = docs(rows + [(None, rows[-1][1])]).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in links.linked_groups(df, size, percent).collect() if r.doc_id is not None}
    sets = [(d, frozenset(shingle_set(t, size))) for d, t in rows + [(None, rows[-1][1])]]
    near = {i: [j for j, (_, o) in enumerate(sets) if j != i and s and o and 100 * len(s & o) >= percent * len(s | o)] for i, (_, s) in enumerate(sets)}
    for i, (d, s) in enumerate(sets[:-1]):
        reached, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in reached]
            reached.update(todo)
        assert got[d] == (len(s), min(sets[j][0] for j in reached if sets[j][0] is not None), len(near[i]))
    assert {(r.doc_id, r.component_id) for r in jaccard.ngram_join(df, size, percent).collect() if r.doc_id is not None} == {(d, c) for d, (_, c, _) in got.items()}


def test_every_link_of_a_large_group(spark, docs):
    """300 near copies that all link with one another: no pair may be missing."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(300):
        words = list(base)
        words[k] = "changed"
        rows.append((k, " ".join(words)))
    df = docs(rows)
    assert links.links(df).count() == 300 * 299 // 2
    assert {(r.n_classes, r.n_links) for r in links.link_counts(df).collect()} == {(299, 299)}


def test_no_documents(spark, docs):
    none = docs([(1, "a")]).limit(0)
    assert links.links(none).collect() == [] and links.link_counts(none).collect() == [] and links.linked_groups(none).collect() == []


def test_blocks_of_a_component(spark, docs, monkeypatch):
    """Components cut into many blocks give the same links and counts."""
    monkeypatch.setattr(links, "BLOCK", 7)
    rng, rows = random.Random(3), []
    for group in range(2):
        text = [f"w{rng.randrange(90)}" for _ in range(70)]
        for k in range(30):
            text[rng.randrange(70)] = f"x{group}_{k}"
            rows.append((group * 100 + k, " ".join(text)))
    df = docs(rows + [(500, rows[3][1])]).repartition(3)
    pairs, counts = brute(rows + [(500, rows[3][1])], 4, 85)
    assert sorted(tuple(r) for r in links.links(df).select("a", "b", "n_a", "n_b", "overlap").collect()) == pairs
    got = links.link_counts(df).select("doc_id", "class_id", "class_size", "n_classes", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == counts


def test_counting_links_makes_no_row_per_link(spark, docs, monkeypatch):
    """Of 300 near copies with 44,850 links, no step may write more than a few rows per document."""
    made = []

    def counted(df, name, original=links.written):
        out = original(df, name)
        made.append((out.count(), name))
        return out

    from segmentlab.llm import components

    for module in (links, jaccard, components):
        monkeypatch.setattr(module, "written", counted)
    base, rows = [f"w{i}" for i in range(400)], []
    for k in range(300):
        words = list(base)
        words[k] = "changed"
        rows.append((k, " ".join(words)))
    got = links.linked_groups(docs(rows)).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 299)}
    # What the prefixes and their buckets hold follows the length of the texts, not the number of links.
    assert max(n for n, name in made if name not in ("met", "link-met")) <= 20 * len(rows), made
