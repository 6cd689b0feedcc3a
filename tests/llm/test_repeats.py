"""Repeated byte strings against brute force."""

import hashlib
import random

import pytest

from segmentlab.llm import suffixes


def brute(rows):
    """Per row: bytes, removed bytes, spans, digest; rows with equal doc_id and text are one document."""
    data = {i: (t or "").encode() for i, (_, t) in enumerate(rows)}
    first = {}
    order = sorted(data, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for p in range(len(data[i]) - 99):
            first.setdefault(data[i][p:p + 100], (rows[i][0], rows[i][1], p))
    out = []
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - 99):
            if first[d[p:p + 100]] != (*rows[i], p):
                gone[p:p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((rows[i][0], len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnop  é\n"
    passages = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (99, 100, 130, 250, 700)]
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 5000), (6, "abc" * 400), (7, "ab" * 90 + "c" * 200 + "ab" * 90)]
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))))
        rows.append((100 - i if i % 7 else 500 + i, "".join(parts)))
    # Whole copies, cut copies, a row without doc_id, and fully equal rows.
    return rows + [(600, rows[20][1]), (601, rows[20][1][3:-3]), (None, rows[21][1] + passages[4]), (602, passages[3]), (602, passages[3])]


@pytest.mark.parametrize("group,collection", [(5000, 1500), (2, 3)])
def test_repeats(docs, monkeypatch, group, collection):
    # Small limits send seeds to the grouping of windows, and cut the work into many collections.
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "COLLECTION", collection)
    rows = texts(group)
    got = suffixes.remove_repeats(docs(rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got)


def test_long_text(docs):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij") for _ in range(1_500_000))
    rows = [(1, base), (2, "zz" + base[1_048_500:1_049_000])]
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs(rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 500, 1)


def test_nothing(docs):
    assert suffixes.remove_repeats(docs([])).collect() == []


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(150):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 6))]
        who, offset, lcp = suffixes.suffix_order(strings)
        found = [strings[w][o:] for w, o in zip(who.tolist(), offset.tolist())]
        assert found == sorted(s[i:] for s in strings for i in range(len(s) + 1))
        for i in range(1, len(found)):
            a, b = found[i - 1], found[i]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("width", [1, 2, 4, 5])
def test_suffix_order_by_symbols_of_several_bytes(width):
    rng = random.Random(width)
    strings = [bytes(rng.choice(b"ab\xf4") for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [b"", b"a", b"abab" * 6, b"abab" * 6]
    who, offset, lcp = suffixes.suffix_order(strings, width)
    assert sorted(zip(who.tolist(), offset.tolist())) == sorted((i, o) for i, s in enumerate(strings) for o in range(len(s) + 1))

    def symbols(i, o):
        s = strings[i][o:]
        return [s[at:at + width] for at in range(0, len(s) // width * width, width)]

    found = [symbols(i, o) for i, o in zip(who.tolist(), offset.tolist())]
    assert found == sorted(found)
    for a, b, common in zip(found, found[1:], lcp.tolist()[1:]):
        assert common == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeated_windows_in_few_rounds(monkeypatch):
    """Windows that start earlier too, at any distance from the ends; a round takes several bytes."""
    rounds = []
    monkeypatch.setattr(suffixes, "_shared", lambda *a, original=suffixes._shared: rounds.append(1) or original(*a))
    rng = random.Random(5)
    common = bytes(rng.choice(b"abcdef") for _ in range(160))
    rows = []
    for k in range(40):
        piece = common[rng.randrange(30):rng.randrange(120, 160)]
        piece = bytes(rng.choice(b"xyz") for _ in range(rng.randrange(20))) + piece + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(20)))
        if len(piece) >= 100:
            rows.append((piece, k, 7 * k, 1000 * k, len(piece) - 99))
    seen, expected = set(), set()
    for piece, k, h, start, r in rows:
        for i in range(r):
            window = piece[i:i + 100]
            if window in seen:
                expected.add((k, h, start + i))
            seen.add(window)
    got = {(d, h, s + i) for d, h, s, r in suffixes.repeated_windows(rows) for i in range(r)}
    assert got == expected and expected
    assert len(rounds) <= max(len(p) for p, *_ in rows) // 4 + 1
